"""The inverted index against a small ranking of its own, and its use by the engine."""

import math
import re
from collections import Counter

from folia.operators import embed, text_index

TEXTS = [(1, "The cat sat on the mat"), (2, "the dog, the DOG and the cat"), (3, None), (4, ""), (5, "Ünïcode straße 42"), (6, "cat " * 50), (7, "mat")]


def brute(texts, asked, k1=1.2, b=0.75):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    n, mean, out = len(words), sum(map(len, words.values())) / len(words), Counter()
    for t in set(re.findall(r"[^\W_]+", asked.lower())):
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(t):
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    return dict(out)


def test_scores_equal_brute_force(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "element_pk long, text string")
    index = text_index.build(df, str(tmp_path / "i"), buckets=4)
    for asked in ("cat", "The MAT dog", "straße 42 nothing", "none", "", "ünïcode"):
        got = {r.id: r.score for r in index.scores(asked).collect()}
        want = brute(TEXTS, asked)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got), asked
    best = [r.id for r in index.search("cat mat", 2).collect()]
    assert best == sorted(brute(TEXTS, "cat mat"), key=lambda i: -brute(TEXTS, "cat mat")[i])[:2]
    plan = index.scores("cat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert "EqualTo(term,cat)" in plan or "In(term" in plan
    none = text_index.build(df.limit(0), str(tmp_path / "none"))
    assert none.scores("cat").count() == 0 and none.texts == 0


def test_engine_ranks_words(spark, tmp_path):
    from folia.plans.engine import Engine

    e = Engine(spark, str(tmp_path), embed.embedder("hashing"), words=True)
    make = lambda rows: spark.createDataFrame(rows, "source_id string, doc_type string, content string")
    docs = [("a", "text", "red apples\n\nblue boats sail"), ("b", "text", "green pears\n\nboats")]
    e.ingest(make(docs))
    assert [r.content_preview for r in e.search_words("boats", 5).collect()] == ["boats", "blue boats sail"]
    docs[1] = ("b", "text", "nothing here")
    e.ingest(make(docs))
    assert [r.content_preview for r in e.search_words("boats", 5).collect()] == ["blue boats sail"]
    assert e.search_hybrid("blue boats sail", 1).first().content_preview == "blue boats sail"
    e.delete(["a"])
    assert e.search_words("boats", 5).count() == 0


def test_blocks_of_postings(spark, tmp_path):
    texts = [(f"k{i % 997}" if i % 50 else None, f"the word w{i % 7} the" if i % 10 else None) for i in range(1000)]
    df = spark.createDataFrame(texts, "k string, text string").repartition(3)
    index = text_index.build(df, str(tmp_path / "i"), "k", buckets=4)
    # a stored row names many texts: one for each word and slice at most, not one for each word of each text
    slices = spark.read.parquet(f"{index.path}/postings").where("term is null").count()
    assert slices <= 6 and spark.read.parquet(f"{index.path}/postings").count() <= slices * (2 + 7 + 1)
    # rows of one id and length are one text with their words added up, as they were
    want = {}
    for k, t in texts:
        w = (t or "").split()
        for x in {*w, None}:
            want[x, k, len(w)] = want.get((x, k, len(w)), 0) + w.count(x)
    assert {(r.term, r.id, r.length): r.tf for r in index.rows.groupBy("term", "id", "length").agg({"tf": "sum"}).withColumnRenamed("sum(tf)", "tf").collect()} == want
    known = {(k, n) for _, k, n in want}
    assert (index.texts, index.words) == (len(known), sum(n for _, n in known))
    again = text_index.write(index.rows.drop("bucket"), str(tmp_path / "again"), 4)
    assert (again.texts, again.words) == (index.texts, index.words) and again.schema == index.schema
    scores = lambda x: {r.id: round(r.score, 9) for r in x.scores("the w3").collect()}
    assert scores(again) == scores(index) and len(scores(index)) == len({k for x, k, _ in want if x == "the"})


def test_hybrid_rank_reads_vectors_once(spark):
    from folia.operators import search

    v = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.1), (3, 11, 0.9), (4, None, 0.2), (5, 12, None)], "element_pk long, doc_id long, score double")
    t = spark.createDataFrame([(10, 20.0), (99, 50.0), (12, 10.0)], "doc_id long, score double")
    got = search.hybrid_rank(t, v, 5, on="doc_id")
    assert [(r.element_pk, round(r.score, 9)) for r in got.collect()] == [(1, 0.95), (2, 0.67), (3, 0.63), (5, 0.3), (4, 0.14)]
    # as the join over the keys of the vectors ranks them, which reads these twice
    by_key = search.hybrid_rank(v.drop("score").join(t, "doc_id").select("element_pk", "score"), v, 5)
    assert by_key.collect() == got.collect()
