"""Hand-written fixtures with golden rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folia.functions import formats, temporal, text, vectors
from folia.operators import edges, explode, markup, search, store, trees
from folia.sources import scan


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_html_tree():
    got = markup.html_elements("<body><main><span><p>One <a href='x'>two</a></p></span></main><ul><li>a<li>b</ul><table><tr><th>H<td>v</table><script>no</script></body>")
    assert [(r[1], r[2], r[3]) for r in got] == [
        ("root", None, None), ("paragraph", 0, "One two"), ("list", 0, "a b"), ("list_item", 2, "a"), ("list_item", 2, "b"), ("table", 0, "H v"), ("table_row", 5, "H v"), ("table_header", 6, "H"), ("table_cell", 6, "v"),
    ]
    assert json.loads(got[1][4])["links"] == ["x"]
    assert markup.html_elements(None) == [(0, "root", None, None, None)]


def test_markdown_headers_nest(spark):
    md = "# A\n\n### B\n\npara\n\n## C\n\n- one\n- two\n\n```py\ncode # no header\n```\n> quote"
    df = spark.createDataFrame([(1, md), (2, None)], "doc_id int, text string")
    got = {r.content: (r.element_type, r.parent_ord) for r in explode.explode_markdown(df).where("doc_id = 1").collect()}
    ord_of = {r.content: r.ord for r in explode.explode_markdown(df).where("doc_id = 1").collect()}
    assert got["A"] == ("header", 0)
    assert got["B"] == ("header", ord_of["A"]) and got["C"] == ("header", ord_of["A"])
    assert got["para"] == ("paragraph", ord_of["B"]) and got["one"] == ("list_item", ord_of["C"])
    assert got["quote"][0] == "blockquote" and any(t == "code_block" for t, _ in got.values())
    assert explode.explode_markdown(df).where("doc_id = 2").count() == 1


def test_markdown_links(spark):
    df = spark.createDataFrame([(1, "see [x](y.md) and [[Z]] and [x](y.md)")], "doc_id int, text string")
    assert sorted(rows(explode.markdown_links(df), "link_text", "link_target")) == [("Z", "Z"), ("x", "y.md"), ("x", "y.md")]


def test_json_nodes(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, true, null, "s", 1.5]}}'), (2, "broken"), (3, None)], "doc_id int, j string")
    got = dict(rows(explode.explode_json(df, "doc_id", "j"), "path", "json_type"))
    assert got == {"$": "object", "$.a": "object", "$.a.b": "array", "$.a.b[0]": "integer", "$.a.b[1]": "boolean", "$.a.b[2]": "null", "$.a.b[3]": "string", "$.a.b[4]": "number"}


def test_xml_kinds():
    got = markup.xml_elements("<items><item k='1'>x</item><item>y</item></items>")
    assert [r[1] for r in got] == ["root", "xml_list", "xml_element", "xml_text", "xml_element", "xml_text"]
    assert markup.xml_elements("<broken")[0][1] == "root"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office_files(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(r[1], r[2]) for r in markup.docx_elements(docx)] == [("root", None), ("body", 0), ("header", 1), ("paragraph", 2), ("table", 2), ("table_row", 4), ("table_cell", 5)]
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = _zip({"xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="One"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row></sheetData></worksheet>'})
    assert [r[1] for r in markup.xlsx_elements(xlsx)] == ["root", "workbook", "sheet", "table_header_row", "table_header", "table_row", "table_cell"]
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    pptx = _zip({"ppt/slides/slide1.xml": f'<s xmlns:a="{a}"><a:p><a:r><a:t>Hello</a:t></a:r></a:p></s>'})
    assert [r[1] for r in markup.pptx_elements(pptx)] == ["root", "presentation_body", "slide", "text_box"]
    bad = spark.createDataFrame([("d", bytearray(b"no zip"))], "doc_id string, content binary")
    assert "error" in markup.explode_markup(bad, "docx").first().metadata


@pytest.mark.parametrize(
    ("s", "kind"),
    [("14:00-16:00", "TIME_RANGE"), ("2-4pm", "TIME_RANGE"), ("3pm", "TIME"), ("12", "TIME"), ("2024-01-01", "DATE"), ("2024-01-01 10:45", "DATETIME"), ("noon", "TIME"), ("x" * 60, "NONE"), ("", "NONE"), (None, "NONE")],
)
def test_temporal_kinds(spark, s, kind):
    assert spark.createDataFrame([(s,)], "s string").select(temporal.temporal_kind(F.col("s"))).first()[0] == kind


def test_temporal_phrases(spark):
    def say(s):
        return spark.createDataFrame([(s,)], "s string").select(temporal.temporal_phrase(F.col("s"))).first()[0]

    assert say("3:45pm") == "at quarter to 4 PM in the afternoon, at minute 45"
    assert say("2-4pm") == "from at o'clock 2 PM in the afternoon until at o'clock 4 PM in the afternoon"
    assert say("2024-01-01").startswith("the month of January (first quarter), in the first week, on Monday day 1, in the year 2024, during the third decade of the 21th")
    assert say("plain words") == "plain words"


def test_column_types_ignore_empty_cells_and_zeros(spark):
    df = spark.createDataFrame([("0", "1.5", "true", "2024-01-02", "0"), ("7", "", "no", "2024-02-03", "abc")], "i string, f string, b string, d string, s string").withColumn("k", F.monotonically_increasing_id())
    got = dict(rows(explode.column_types(explode.explode_cells(df, "k", ["i", "f", "b", "d", "s"])), "header", "inferred_type"))
    assert got == {"i": "integer", "f": "float", "b": "boolean", "d": "date", "s": "string"}


def test_detection(spark):
    df = spark.createDataFrame([("a,b\n1,2\n",), ("# Title\ntext",), ("<html><body>x</body></html>",), ('{"a": 1}',), ("<r><x/></r>",), ("plain",), ("",)], "t string")
    assert [r[0] for r in df.select(formats.type_from_content(F.col("t"))).collect()] == ["csv", "markdown", "html", "json", "xml", "text", "text"]
    raw = spark.createDataFrame([(bytearray(b"%PDF-1.4"),), (bytearray(b"PK\x03\x04..word/document"),), (bytearray(b"abc"),), (bytearray(b"\xff\xfe\x00"),)], "c binary")
    assert [r[0] for r in raw.select(formats.type_from_magic(F.col("c"))).collect()] == ["pdf", "docx", "text", "binary"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, [0.6, 0.8])], "element_pk long, embedding array<float>")
    assert [r.element_pk for r in search.top_k(df, [1.0, 0.0], 4).collect()] == [1, 3, 5, 2]
    assert df.where("element_pk = 4").select(vectors.cosine(F.col("embedding"), vectors.literal([1.0, 0.0]))).first()[0] == 0.0
    got = search.knn_join(df, df, 1, block=2).orderBy("source").collect()
    assert [(r.source, r.target) for r in got] == [(1, 3), (2, 1), (3, 1), (5, 1)]
    assert search.knn_join(df.limit(0), df, 1).count() == 0


def test_link_targets(spark):
    el = spark.createDataFrame([("d", "e1", 1, "header", '{"text": "Intro", "level": 1}'), ("d", "e2", 2, "paragraph", '{"id": "anchor"}'), ("d", "e3", 3, "header", '{"text": "Intro", "level": 1}')], "doc_id string, element_id string, ord int, element_type string, metadata string")
    links = spark.createDataFrame([("d", "s", "see", "#anchor"), ("d", "s", "Intro", "x.md"), ("d", "s", None, "http://x"), ("d", None, "a", "b")], "doc_id string, source_id string, link_text string, link_target string")
    got = rows(edges.link_edges(links, el).where("relationship_type = 'referenced_by'"), "source_id", "target_reference")
    assert sorted(got) == [("e1", "s"), ("e2", "s")]


def test_trees_end_on_cycles(spark):
    el = spark.createDataFrame([("a", "b", "d"), ("b", "a", "d")], "element_id string, parent_id string, doc_id string")
    assert trees.ancestry(el.select("element_id"), el, 3).count() == 4
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    got = trees.crawl(spark.createDataFrame([("a",)], "node string"), links, 5)
    assert sorted(rows(got, "node", "depth")) == [("a", 0), ("b", 1), ("c", 2)]


def test_replacement_keeps_keys(spark):
    old = spark.createDataFrame([("d", "e1", "h1", 1), ("d", "e2", "h2", 2), ("x", "e9", "h9", 3)], "doc_id string, element_id string, content_hash string, element_pk long")
    new = spark.createDataFrame([("d", "e1", "h1"), ("d", "e2", "changed"), ("d", "e3", "h3")], "doc_id string, element_id string, content_hash string")
    got = dict(rows(store.replace_elements(old, new), "element_id", "element_pk"))
    assert got["e1"] == 1 and got["e9"] == 3 and {got["e2"], got["e3"]} == {4, 5}


def test_pointers(spark):
    df = spark.createDataFrame([("one two one",)], "t string")
    assert df.select(text.occurrence(F.col("t"), "one", 1, 2)).first()[0] == "...o one"
    assert df.select(text.occurrence(F.col("t"), "one", 5)).first()[0] == "Occurrence 5 not found. String 'one' appears 2 times."
    assert df.select(text.occurrence(F.col("t"), "zz")).first()[0] == "String 'zz' not found in content."


def test_file_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# hi")
    (tmp_path / "y.pdf").write_bytes(b"%PDF")
    (tmp_path / "z.tmp").write_text("no")
    got = scan.file_source(spark, str(tmp_path), exclude_extensions=["tmp"])
    assert sorted(rows(got, "doc_type", "content")) == [("markdown", "# hi"), ("pdf", None)]


def test_record_and_blob_sources(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff\xfe"))], "id int, c binary")
    assert [r.content for r in scan.blob_source(df, "db", "id", "c").orderBy("source_id").collect()] == ["ok", "<binary data: 2 bytes>"]
    assert [r.content for r in scan.record_source(df.select("id"), "mongodb", "id", wanted={"id": [2]}).collect()] == ['{"id":2}']


def test_engine_ingests_once_and_again(spark, tmp_path):
    from folia.plans.engine import Engine

    def embed(rows):
        return rows.select("element_pk", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))

    e = Engine(spark, str(tmp_path), embed)
    docs = [("a", "text", "one two\n\nthree"), ("b", "markdown", "# H\n\npara"), ("c", "html", "<p>x</p>")]
    got = e.ingest(spark.createDataFrame(docs, "source_id string, doc_type string, content string"))
    assert got["documents"] == 3 and got["unchanged"] == 0 and got["elements"] == 3 + 3 + 2
    docs[0] = ("a", "text", "one two\n\nfour")
    got = e.ingest(spark.createDataFrame(docs, "source_id string, doc_type string, content string"))
    assert got["documents"] == 1 and got["unchanged"] == 2 and got["elements"] == 3
    assert e.table("elements").count() == 8 and e.table("documents").count() == 3
    assert e.search([1.0, 0.0], 2).count() == 2 and e.top_documents([1.0, 0.0], 3).count() >= 1
    assert e.search_outline([1.0, 0.0], 1).count() == 2 or e.search_outline([1.0, 0.0], 1).count() == 3
    assert e.search_enriched([1.0, 0.0], 1).first().relationships
    e.delete(["a"])
    assert e.table("elements").count() == 5 and e.table("documents").count() == 2


def test_context_has_whole_contents(spark, tmp_path):
    from folia.operators import trees
    from folia.plans.engine import Engine

    a, b, c = "a " * 300 + "end", "b " * 700 + "end", "short"
    df = spark.createDataFrame([(1, "\n\n".join([a, b, c]))], "doc_id int, text string")
    got = [r.text for r in trees.context(explode.with_ids(explode.explode_text(df), whole=True)).orderBy("ord").collect()]
    cut = " ".join(["b"] * 500)
    assert got == ["\n\n".join(x) for x in ([a, cut], [cut, a, c], [c, cut])]
    e = Engine(spark, str(tmp_path), lambda rows: rows.select("element_pk", F.array(F.length("text").cast("float")).alias("embedding")))
    e.ingest(spark.createDataFrame([("s", "text", "\n\n".join([a, b, c]))], "source_id string, doc_type string, content string"))
    assert sorted(r.embedding[0] for r in e.table("embeddings").collect()) == sorted(float(len(x)) for x in got)


def test_rectangles(spark):
    from folia.operators import geometry

    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    got = spark.range(1).select(geometry.overlaps(lit(0, 0, 2, 2), lit(2, 2, 3, 3)), geometry.overlaps(lit(0, 0, 1, 1), lit(2, 2, 3, 3)), geometry.distance(lit(0, 0, 1, 1), lit(4, 5, 6, 6)), geometry.column_number(F.lit("AA7"))).first()
    assert tuple(got) == (True, False, 5.0, 27)
