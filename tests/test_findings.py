"""What reviews of round 3 found, on small inputs that failed before."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folia import catalog
from folia.functions import temporal
from folia.operators import markup, render, search, vector_index

#: Lines that begin or end with the digits of their own number, white space of several kinds, blanks, nothing.
ODD_LINES = ["0997 first 0\n1219 second 1\n22 third 2\n  3 fourth 3  \n4", "0\n1\n2\n\n 4 \n5 5", "\t0 tab 0\t\n1 1", "  \n0 after a blank\n10\n010", "", None, "10\n" * 12 + "10 11 12"]


def equal_to_sql(spark, tmp_path, name, **tables):
    """The query and its SQL give the same rows over the tables (name: (schema, rows))."""
    db = duckdb.connect()
    db.sql("set timezone='UTC'")
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        db.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)), db.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    expected = Counter(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == expected and expected


@pytest.mark.parametrize("name", ["element_context", "outgoing_edges", "text_elements", "content_search", "child_lists"])
def test_lines_lose_spaces_only(spark, tmp_path, name):
    texts = [*ODD_LINES, "the th 0\n1 in the theatre 1"]
    equal_to_sql(spark, tmp_path, name, documents=("doc_id long, text string", list(enumerate(texts))))


def test_titles_lose_spaces_only(spark, tmp_path):
    equal_to_sql(spark, tmp_path, "text_statistics", documents=("doc_id long, text string", list(enumerate(ODD_LINES))))


ODD_TIMES = ["2024-01-01", " 2024/02/29 ", "2023/02/29", "2/9/2024", "+5/6/2024", "12 JAN 2024", "january 12, 2024", "May 5 2024", "20241301", "20240101", "+12024-01-01", "12024-01-01", "2024-01-01t10:45", "2024-01-01 24:00", "2024-01-01\n", "Customer#000000001", "event click", "noon", "noonx", "3 a.m.", "14:00-16:00", "2t4pm", "", None]


def test_date_readers_are_left_to_strings_of_their_shape(spark):
    forms = [*temporal.DATES, *temporal.DATETIMES]
    df = spark.createDataFrame([(t,) for t in ODD_TIMES], "t string")
    c = F.trim("t")
    read = df.select(*(F.try_to_timestamp(c, F.lit(f)).isNotNull().alias(f"r{i}") for i, f in enumerate(forms)), *(c.rlike(temporal.shape(f)).alias(f"s{i}") for i, f in enumerate(forms))).collect()
    assert all(r[f"s{i}"] for r in read for i in range(len(forms)) if r[f"r{i}"])
    # a reader that fails does so by an exception; of 17 at most one or two are asked
    assert max(sum(bool(r[f"s{i}"]) for i in range(len(forms))) for r in read) <= 2
    kinds = [r.k for r in df.select(temporal.temporal_kind(F.col("t")).alias("k")).collect()]
    assert kinds == "DATE DATE NONE DATE NONE DATE DATE DATE NONE DATE DATE NONE DATETIME NONE NONE NONE NONE TIME NONE TIME TIME_RANGE NONE NONE NONE".split()


def test_plans_of_rendered_cells_are_small(spark):
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("content"), F.lit("table_cell").alias("element_type"), F.lit("{}").alias("metadata")).select(c)._jdf.queryExecution().analyzed().toString()
    assert len(plan(render.own_text(spark.range(0)))) < 200_000


def test_vectors_of_candidates_are_not_shuffled(spark, tmp_path):
    v = spark.range(300).select(F.col("id").alias("element_pk"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    near = vector_index.build(v, str(tmp_path / "i"), lists=8).knn_join(v, 3, probes=8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert near.count() == 900


def test_long_documents_go_on_in_batches(spark):
    n = markup.BATCH + 500
    docs = spark.createDataFrame([(i, "<r>" + "".join(f"<x>{k}</x>" for k in range(n)) + "</r>") for i in (1, 2)] + [(3, "<broken")], "doc_id long, content string").coalesce(1)
    got = {r.doc_id: r for r in markup.explode_markup(docs, "xml").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.expr("parent_type = 'xml_list' and element_type = 'xml_element'")).alias("below"), F.countDistinct("ord").alias("places")).collect()}
    assert all((got[d].n, got[d].below, got[d].places) == (2 * n + 2, n, 2 * n + 2) for d in "12") and got["3"].n == 1


def test_every_vector_asks_for_its_neighbours(spark, tmp_path):
    """None is left out as a query; equal vectors come in order of their keys, also where they fill the 20 places."""
    value = lambda i: [((i * 7919 + d * 104729 + i * i * d) % 1009 - 400) / 1009 for d in range(64)]
    rows = [(i, value(i % 37 if i % 3 else i), i % 5) for i in sorted(range(1, 300), key=lambda i: i * 71 % 307)]
    equal_to_sql(spark, tmp_path, "cross_document_neighbours", embeddings=("vec_id long, embedding array<float>, label int", rows))
    got = catalog.queries()["cross_document_neighbours"](spark, str(tmp_path)).select("source").distinct().collect()
    assert {r.source for r in got} == set(range(1, 300))


def test_blocks_and_tiles_give_the_same_neighbours(spark):
    v = spark.range(9000).select((F.col("id") * 7919 % 9001).alias("element_pk"), F.floor(F.col("id") / 40).alias("kin"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") % 5000 * i).cast("float")).alias("embedding"))
    pairs = lambda **x: {tuple(r) for r in search.knn_join(v, v, 5, group="kin", threshold=0.2, **x).collect()}
    whole = pairs()
    assert whole == pairs(block=3000, corpus_block=2000) and len(whole) == 5 * 8998  # two vectors are zero
