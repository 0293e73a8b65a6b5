"""Every registered query against its SQL on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

from folia import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = db.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    expected = sorted(tuple(text(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
    assert sorted(tuple(text(r[c]) for c in names) for r in rows) == expected


def test_flagship_pushes_its_filter_down(spark):
    plan = catalog.queries()[catalog.FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(label" in plan and "TakeOrderedAndProject" in plan


def test_hybrid_rank_leaves_no_vector_out(spark):
    assert any(r.element_pk % 6 in (1, 5) for r in catalog.queries()["hybrid_rank_whole"](spark, SF).collect())


def brute_markdown(text):
    """(element_type, parent_type) of the blocks of a text."""
    out, headers, code, last = [("root", None)], [], False, None
    for line in (text or "").split("\n"):
        fence = re.match(r"\s*```", line)
        level = re.match(r"(#{1,6})\s+\S", line)
        if fence or code:
            kind, code = "code_block", code != bool(fence)
        elif level:
            kind = "header"
        elif not line.strip(" "):
            kind = "blank"
        else:
            kind = next((k for k, x in (("list_item", r"\s*([-*+]|\d+[.)])\s+"), ("blockquote", r"\s*>"), ("table_row", r"\s*\|.*\|\s*$")) if re.match(x, line)), "paragraph")
        if kind != "blank" and (kind != last or kind in ("header", "list_item", "table_row")):
            if kind == "header":
                n = len(level.group(1))
                out.append((kind, "header" if any(x < n for x in headers) else "root"))
                headers.append(n)
            else:
                out.append((kind, "header" if headers else "root"))
        last = kind
    return out


def test_markdown_of_whole_turns(spark, tmp_path):
    texts = ["one line", "# A\n\npara\nmore\n\n- x\n- y\n\n> q\n> r\n\nlast", "| a | b |\n|---|---|\n| 1 | 2 |", "```py\n# no header\n\nx = 1\n", "after the open fence\n\n## B\n\n1. one\n2) two", "", None, "one line"]
    turns = [(i // 5, i % 5, "user", t) for i, t in enumerate(texts)] + [(0, 1, "user", texts[1])]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = Counter((c, *x) for c, _, _, t in turns for x in brute_markdown(t))
    assert {(r.doc_id, r.element_type, r.parent_type): r.n for r in catalog.queries()["markdown_turns"](spark, str(tmp_path)).collect()} == want
    whole = {(c, *x): n for (c, *x), n in Counter((r.conv_id, *x) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() for x in brute_markdown(r.text)).items()}
    assert {(r.doc_id, r.element_type, r.parent_type): r.n for r in catalog.queries()["markdown_turns"](spark, SF).collect()} == whole
