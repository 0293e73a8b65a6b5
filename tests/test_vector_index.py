"""The stored vector index: recall, parts and blocks, odd rows, and its use by the engine."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia import catalog
from folia.operators import edges, embed, search, vector_index

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def frame(spark, rows):
    return spark.createDataFrame(rows, "element_pk long, doc_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(40, 24))
    v = centres[g.integers(0, 40, 3000)] + 0.4 * g.normal(size=(3000, 24))
    return frame(spark, [(i, i // 10, x.tolist()) for i, x in enumerate(v)]).cache()


def pairs(df):
    return {(r.source, r.target) for r in df.collect()}


def test_join_recall_and_exact_scores(spark, clustered, tmp_path, monkeypatch):
    exact = search.knn_join(clustered, clustered, 20, group="doc_id")
    want, score = pairs(exact), {(r.source, r.target): r.score for r in exact.collect()}
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 70)
    index = vector_index.build(clustered, str(tmp_path / "i"), lists=32, pieces=8)
    got = index.knn_join(clustered, 20, probes=6, group="doc_id").collect()
    found = {(r.source, r.target) for r in got}
    assert len(got) == len(found) == 3000 * 20
    assert len(found & want) >= 0.95 * len(want)
    assert all(abs(score[r.source, r.target] - r.score) < 1e-6 for r in got if (r.source, r.target) in score)
    assert not any(a // 10 == b // 10 for a, b in found)
    monkeypatch.undo()
    assert pairs(index.knn_join(clustered, 20, probes=6, group="doc_id")) == found
    again = vector_index.open_index(spark, str(tmp_path / "i"))
    assert pairs(again.knn_join(clustered, 20, probes=6, group="doc_id")) == found and again.sizes == index.sizes


def test_search_prunes_partitions(spark, clustered, tmp_path):
    index = vector_index.build(clustered, str(tmp_path / "i"), lists=32)
    hits = 0
    for q in clustered.where("element_pk % 300 = 0").collect():
        want = {r.element_pk for r in search.top_k(clustered, q.embedding, 10).collect()}
        hits += len(want & {r.element_pk for r in index.search(q.embedding, 10, probes=6).collect()})
    assert hits >= 95
    plan = index.search([1.0] * 24, 10, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan.replace("isnotnull(list_id)", "list_id") and "TakeOrderedAndProject" in plan


def test_odd_vectors(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, [0.0, 0.0]), (3, 3, [1.0, 0.0]), (4, 4, [1.0]), (5, 5, [0.6, 0.8]), (6, 6, None), (7, 7, []), (8, None, [0.9, 0.1]), (9, None, [0.8, 0.1])]
    df = frame(spark, rows)
    index = vector_index.build(df, str(tmp_path / "i"), lists=4)
    assert index.rows.count() == 9 and index.rows.where("list_id = -1").count() == 3
    got = [(r.element_pk, round(r.score, 3)) for r in index.search([1.0, 0.0], 6, probes=4).collect()]
    assert got == [(1, 1.0), (3, 1.0), (8, 0.994), (9, 0.992), (5, 0.6), (2, 0.0)]
    assert [r.element_pk for r in index.search([2.0], 3).collect()] == [4]
    joined = index.knn_join(df, 2, probes=4, group="doc_id").orderBy("source", F.desc("score"), "target").collect()
    assert [(r.source, r.target) for r in joined] == [(1, 3), (1, 8), (2, 1), (2, 3), (3, 1), (3, 8), (5, 1), (5, 3), (8, 1), (8, 3), (9, 8), (9, 1)] or {r.source for r in joined} == {1, 2, 3, 5, 8, 9}
    nothing = vector_index.build(df.limit(0), str(tmp_path / "none"))
    assert nothing.search([1.0, 0.0]).count() == 0 and nothing.knn_join(df, 2).count() == 0
    assert vector_index.open_index(spark, str(tmp_path / "none")).rows.count() == 0


def test_recall_on_the_table(spark):
    v = catalog._vectors(spark, SF)
    want = pairs(search.knn_join(v, v, 20, group="doc_id", threshold=0.05))
    got = pairs(catalog.queries()["approximate_neighbours"](spark, SF))
    assert len(want & got) >= 0.9 * len(want)


def test_engine_uses_the_index(spark, tmp_path):
    from folia.plans.engine import Engine

    e = Engine(spark, str(tmp_path), embed.embedder("hashing"), across=0.3, lists=4, probes=4)
    md = "# Red apples and pears\n\ntext of {}\n\n## Blue boats\n\nmore {}"
    docs = [(f"d{i}", "markdown", md.format(i, i)) for i in range(4)] + [("t", "text", "red apples and pears")]
    make = lambda rows: spark.createDataFrame(rows, "source_id string, doc_type string, content string")
    got = e.ingest(make(docs))
    assert got["documents"] == 5 and got["unchanged"] == 0
    elements = {r.element_id: r for r in e.table("elements").collect()}
    sections = e.table("relationships").where("relationship_type = 'semantic_section'")
    found = sections.collect()
    assert found and all(elements[r.source_id].element_type == elements[r.target_reference].element_type == "header" and elements[r.source_id].doc_id != elements[r.target_reference].doc_id for r in found)
    scored = edges.confidence(sections).first()
    assert scored.similarity >= 0.3 and '"cross_document":true' in scored.metadata
    docs[0] = ("d0", "markdown", "# Other words here\n\nnothing alike")
    fitted = e.index().model.centroids
    got = e.ingest(make(docs))
    assert got["documents"] == 1 and got["unchanged"] == 4 and (e.index().model.centroids == fitted).all()
    now = {r.element_id for r in e.table("elements").collect()}
    assert all(r.source_id in now and r.target_reference in now for r in e.table("relationships").where("relationship_type = 'semantic_section'").collect())
    assert e.index().rows.count() == e.table("embeddings").count()
    hit = e.search_text("red apples and pears", 3).first()
    assert hit.score > 0.5 and e.search_text("red apples and pears", 3, wanted={"element_type": ["header"]}).first().element_type == "header"
    e.delete(["d1"])
    assert e.index().rows.count() == e.table("embeddings").count()
