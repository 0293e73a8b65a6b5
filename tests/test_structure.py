"""Beyond former limits: deep trees, wide sheets, links, embedders, lists, pointers, settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.functions import formats, values
from folia.operators import edges, embed, explode, markup, render, search, store, trees
from folia.sources import resolve
from folia.sources.config import Config
from tests.test_operators import _zip, rows


def test_sheets_have_no_caps():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    wide = "".join(f'<c r="X{c}"><v>{c}</v></c>' for c in range(101))
    long = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(2, 1003))
    data = _zip({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1">{wide}</row>{long}</sheetData></worksheet>'})
    got = [r[1] for r in markup.xlsx_elements(data)]
    assert got.count("table_header") == 101 and got.count("table_row") == 1001


def test_deep_trees_are_walked_to_the_end(spark):
    deep = '{"a":' * 14 + "1" + "}" * 14
    got = explode.explode_json(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j")
    assert got.agg(F.max("depth")).first()[0] == 14
    el = spark.createDataFrame([(f"e{i}", f"e{i - 1}" if i else None, "d") for i in range(13)], "element_id string, parent_id string, doc_id string")
    assert trees.paths(el).agg(F.max("depth")).first()[0] == 12
    assert trees.ancestry(el.where("element_id = 'e12'"), el).count() == 13
    ring = spark.createDataFrame([("a", "b", "d"), ("b", "c", "d"), ("c", "a", "d")], "element_id string, parent_id string, doc_id string")
    assert trees.ancestry(ring.select("element_id"), ring).count() == 9


def test_many_sentences_keep_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "A. " * 10_001 + "\n\nB.")], "doc_id int, text string")
    got = explode.explode_sentences(explode.explode_text(df))
    assert got.count() == got.select("ord").distinct().count() == 1 + 2 + 10_001 + 1


def test_magic_looks_at_the_whole_file(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04" + b"x" * 5000 + b"xl/workbook.xml"),)], "c binary")
    assert df.select(formats.type_from_magic(F.col("c"))).first()[0] == "xlsx"


def test_csv_text():
    text = "﻿\n\nDate; Name ;Note\n2024-01-01; a;\"x;y\"\n\n2024-01-02;b;\n"
    assert markup.csv_table(text) == [["Date", "Name", "Note"], ["2024-01-01", "a", "x;y"], ["2024-01-02", "b", ""]]
    got = markup.csv_elements(text)
    assert [r[1] for r in got] == ["root", "table", "table_header_row"] + ["table_row"] + ["table_cell"] * 3 + ["table_row"] + ["table_cell"] * 3
    assert json.loads(got[4][4])["header"] == "Date" and markup.csv_elements(None) == [(0, "root", None, None, None)]


def test_json_elements():
    got = markup.json_elements('{"a": [1, {"b": null}], "c": "x"}')
    assert [(r[1], r[2], json.loads(r[4])["json_path"] if r[4] else None) for r in got] == [("root", None, None), ("json_object", 0, "$"), ("json_array", 1, "$.a"), ("json_item", 2, "$.a[0]"), ("json_object", 2, "$.a[1]"), ("json_field", 4, "$.a[1].b"), ("json_field", 1, "$.c")]
    assert "error" in markup.json_elements("{broken")[0][4]


def test_pdf_text():
    import zlib

    one = b"BT /F1 18 Tf 72 700 Td (Head \\(1\\)) Tj ET"
    two = zlib.compress(b"BT /F1 10 Tf 72 700 Td [(Sec) -20 (ond)] TJ T* (line) Tj ET")
    data = b"%PDF-1.4\n1 0 obj<<>>stream\n" + one + b"\nendstream\n2 0 obj<<>>stream\n" + two + b"\nendstream"
    assert [(r[1], r[3]) for r in markup.pdf_elements(data)] == [("root", None), ("page_content", None), ("page", None), ("header", "Head (1)"), ("page", None), ("paragraph", "Second"), ("paragraph", "line")]


def test_markdown_statistics_and_links(spark):
    md = "# T\n\n- a\n- [x](u) and [y](u)\n\n```py\n1\n```\n## B"
    df = spark.createDataFrame([(md,)], "t string")
    got = df.select(*explode.markdown_stats(F.col("t"))).first()
    assert tuple(got) == (2, 2, 1, 2, 1, "T", "py")
    cells = spark.createDataFrame([(1, 0, "see http://a.b/c or me@x.org")], "row_key int, col int, value string")
    assert sorted(rows(explode.cell_links(cells), "link_target")) == [("http://a.b/c",), ("mailto:me@x.org",)]
    xml = markup.explode_markup(spark.createDataFrame([("d", "<r><a href='u'/><b ref='v'/></r>")], "doc_id string, content string"), "xml")
    assert sorted(rows(markup.markup_links(xml), "link_target", "link_type")) == [("u", "link"), ("v", "referenced_by")]


def test_rendering(spark):
    el = [(1, "list_item", "x", None), (2, "code_block", "1", '{"language":"py"}'), (3, "blockquote", "a\nb", None), (4, "image", None, '{"alt":"cat"}'), (5, "json_field", "Ann", '{"name":"name"}'), (6, "xml_element", "v", '{"path":"/r/k[1]","attributes":{"b":"2","a":"1"}}'), (7, "paragraph", "p", None)]
    df = spark.createDataFrame(el, "i int, element_type string, content string, metadata string")
    assert [r.text for r in render.with_text(df).orderBy("i").collect()] == ["- x", "Code (py):\n1", "> a\n> b", "Image: cat", 'name is "Ann"', 'k: v (a is "1", b is "2")', "p"]
    table = explode.with_ids(markup.explode_markup(spark.createDataFrame([("d", "h,i\nx,y\nz,w")], "doc_id string, content string"), "csv"), whole=True)
    assert [r.text for r in render.table_previews(table, 2).collect()] == ["h: x | i: y\nh: z | i: w"]


def test_sections(spark):
    df = spark.createDataFrame([(1, "# A\n\np\n\n## B\n\nq")], "doc_id int, text string")
    el = explode.with_ids(explode.explode_markdown(df), whole=True)
    name = dict(rows(el, "element_id", "content"))
    got = {name[a]: name[b] for a, b in rows(trees.sections(el), "element_id", "section_id")}
    assert got == {"p": "A", "q": "B"}


def test_embedders(spark):
    e = embed.embedder("hashing", dimensions=32)
    got = {r.element_pk: r.embedding for r in e(spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "element_pk long, text string")).collect()}
    assert got[1] == got[2] and set(got[3]) == {0.0} and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    with pytest.raises(ValueError):
        embed.embedder("none")


def test_engine_routes_formats_and_finds_all_kinds_of_edges(spark, tmp_path):
    from folia.plans.engine import Engine

    e = Engine(spark, str(tmp_path), embed.embedder("hashing"), semantic=0.5, across=0.0)
    docs = [("a.csv", None, "k,v\n1,2\n3,4\n"), ("b.json", None, '{"x": 1}'), ("c", None, "# Top\n\nred blue green\n\nred blue green too\n\n[see](#Top) [Top](x)"), ("d", None, None)]
    got = e.ingest(spark.createDataFrame(docs, "source_id string, doc_type string, content string"))
    assert got["documents"] == 4
    kinds = {r.element_type for r in e.table("elements").collect()}
    assert {"table_cell", "json_field", "header", "paragraph"} <= kinds
    found = {r.relationship_type for r in e.table("relationships").collect()}
    assert {"link", "referenced_by", "semantic_similarity", "next_sibling", "contained_by"} <= found
    top = e.search_text("red blue green", 2).collect()
    assert top[0].content_preview.startswith("red blue green") and e.counts()["documents"] == 4
    assert e.document_elements("c").count() == 5 and e.element(top[0].element_id).count() == 1
    assert store.current(spark, str(tmp_path), "nothing") is None


def test_pointers_and_paths(spark):
    df = spark.createDataFrame([("db://c/t/id/7/body", "mongodb://h/d/c/1/f", "s3://b/k/x", "http://h/a/b/c?q")], "d string, m string, s string, u string")
    got = df.select(resolve.db_parts(F.col("d")).alias("d"), resolve.mongo_parts(F.col("m")).alias("m"), resolve.object_parts(F.col("s")).alias("s"), values.join_url(F.col("u"), F.lit("../z#f")), values.join_url(F.col("u"), F.lit("//o/p")), values.local_links(F.lit("/a/b.md"), F.lit("../c.md#x")), resolve.supports(F.col("d")), values.epoch(F.lit("Mon, 01 Jan 2024 00:00:10 GMT"))).first()
    assert got[0].key == "7" and got[0].content_type is None and got[1].field == "f" and got[2].key == "k/x"
    assert tuple(got)[3:] == ("http://h/a/z", "http://o/p", "/c.md", True, 1704067210.0)
    html = spark.createDataFrame([("<html lang='de'><title> T </title>",)], "h string").select(*resolve.html_facts(F.col("h"))).first()
    assert tuple(html) == ("T", None, "de")


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("FOLIA_PATH", "/x")
    c = Config.of({"storage": {"path": "${FOLIA_PATH}/d"}, "sources": ["${NONE:-y}"], "other": 1})
    assert c.storage["path"] == "/x/d" and c.sources == ["y"] and c.embedding["provider"] == "hashing"
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c
    assert search.capped(500, -1) == (100, 0.0) and search.capped(None, None) == (10, 0.0)


def test_edge_order(spark):
    df = spark.createDataFrame([("1", "link", '{"confidence":0.2}'), ("2", "semantic_similarity", '{"similarity":0.9}'), ("3", "link", '{"confidence":0.7}')], "relationship_id string, relationship_type string, metadata string")
    assert [r.relationship_id for r in edges.by_confidence(df).collect()] == ["3", "1", "2"]
    assert rows(edges.between(df, category_="SEMANTIC"), "relationship_id") == [("2",)]
