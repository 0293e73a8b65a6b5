"""Interval labels, ancestors, paths and outlines against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import trees

SCHEMA = "doc_id string, element_id string, parent_id string, ord int, element_type string"


def forest(r, doc, n, odd):
    """Elements in any order; ``odd`` adds missing parents and cycles."""
    out = []
    for k in range(n):
        up = f"{doc}.{r.randrange(k)}" if k and r.random() < 0.9 else None
        if odd and r.random() < 0.1:
            up = r.choice([f"{doc}.none", f"{doc}.{r.randrange(n)}"])
        out.append((doc, f"{doc}.{k}", up, r.randrange(100), r.choice(["p", "div"])))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    out = [x for d in range(60) for x in forest(r, f"d{d}", r.randint(1, 40), d % 3 == 0)]
    out += [("deep", f"deep.{k}", f"deep.{k - 1}" if k else None, k, "p") for k in range(600)]
    return out


def brute_chain(up, x):
    out = []
    while x in up and x not in out:
        out.append(x)
        x = up[x]
    return out


def test_ancestry_paths_and_outline(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    up = {e: p for _, e, p, *_ in rows}
    hits = [x for x in rows if x[1].endswith(("3", "7"))] + [("d1", "d1.none", None, 0, "p")]
    h = spark.createDataFrame([(x[0], x[1], float(i)) for i, x in enumerate(hits)], "doc_id string, element_id string, score double")
    want = sorted((x[1], a, d) for x in hits for d, a in enumerate(brute_chain(up, x[1])))
    assert sorted(tuple(r) for r in trees.ancestry(h, df).collect()) == want
    assert sorted(tuple(r) for r in trees.ancestry(h.select("element_id"), df, 2).collect()) == [x for x in want if x[2] <= 2]
    got = {r.element_id: (r.depth, r.path) for r in trees.paths(df).collect()}
    chains = {x: brute_chain(up, x) for x in up}
    rooted = {x: c for x, c in chains.items() if up[c[-1]] is None}
    doc = {x[1]: x[0] for x in rows}
    assert got == {x: (len(c) - 1, "/".join([doc[x], *reversed(c)])) for x, c in rooted.items()}
    assert {r.element_id for r in trees.paths(df, 1).collect()} == {x for x, c in rooted.items() if len(c) <= 2}
    seen = {a for x in hits for a in chains.get(x[1], [])}
    score = {x[1]: float(i) for i, x in enumerate(hits)}
    assert {r.element_id: r.score for r in trees.outline(h, df).collect()} == {x: score.get(x) for x in seen}
    assert trees.outline(h.limit(0), df).count() == trees.ancestry(h, df.limit(0)).count() == trees.paths(df.limit(0)).count() == 0


def test_labels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    up, ords, doc = {e: p for _, e, p, *_ in rows}, {e: o for _, e, _, o, _ in rows}, {x[1]: x[0] for x in rows}
    got = {r.element_id: r for r in trees.labelled(df).collect()}
    chains = {x: brute_chain(up, x) for x in up}
    rooted = {x for x, c in chains.items() if up[c[-1]] is None}
    assert set(got) == rooted
    below = {x: [] for x in rooted}
    for y in rooted:
        for x in chains[y]:
            below[x].append(y)
    for x in rooted:
        inside = [y for y in rooted if doc[y] == doc[x] and got[x].pre <= got[y].pre <= got[x].last] if doc[x] != "deep" else below[x]
        assert sorted(inside) == sorted(below[x]) and got[x].last - got[x].pre + 1 == len(below[x]) and got[x].depth == len(chains[x]) - 1
    families = {}
    for x in rooted:
        families.setdefault((doc[x], up[x]), []).append(x)
    for kids in families.values():
        by = sorted(kids, key=lambda x: got[x].place)
        assert [got[x].place for x in by] == [*range(1, len(kids) + 1)] and [ords[x] for x in by] == sorted(ords[x] for x in kids)
        assert [got[x].pre for x in by] == sorted(got[x].pre for x in kids)
    r = got["d1.0"]
    assert [x.element_id for x in trees.subtree(trees.labelled(df), "d1", r.pre, r.last).collect()] == sorted(below["d1.0"], key=lambda x: got[x].pre)


def test_one_shuffle_at_any_depth(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    hits = df.select("doc_id", "element_id", F.lit(1.0).alias("score"))
    for got in (trees.ancestry(hits, df), trees.paths(df), trees.outline(hits, df), trees.labelled(df)):
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
