"""Following links: cycles end, least depths win, and a stopped run goes on."""

import pytest

from folia.streaming import follow


def links_of(spark, pairs):
    df = spark.createDataFrame(pairs, "source string, target string")
    return lambda new: df.join(new.withColumnRenamed("target", "source"), "source", "left_semi")


def depths(df):
    rows = df.collect()
    assert len(rows) == len({r.target for r in rows})
    return {r.target: r.depth for r in rows}


PAIRS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "long1"), ("long1", "long2"), ("long2", "d"), ("b", "d"), ("d", None), ("x", "y")]


def test_cycles_end_at_least_depths(spark, tmp_path):
    root, seen = str(tmp_path), []
    follow.add_seeds(spark.createDataFrame([("a",), ("a",), (None,)], "target string"), root)
    got = follow.follow(spark, root, links_of(spark, PAIRS), None, lambda new: seen.append(sorted(r.target for r in new.collect())))
    assert depths(got) == {"a": 0, "b": 1, "long1": 1, "c": 2, "d": 2, "long2": 2}
    assert seen == [["a"], ["b", "long1"], ["c", "d", "long2"]]
    # a seed that was reached before is nearer now; what it leads to as well
    follow.add_seeds(spark.createDataFrame([("long2",), ("x",)], "target string"), root)
    again = follow.follow(spark, root, links_of(spark, PAIRS), None, lambda new: seen.append(sorted(r.target for r in new.collect())))
    assert depths(again) == {"a": 0, "b": 1, "long1": 1, "c": 2, "d": 1, "long2": 0, "x": 0, "y": 1}
    assert seen[3:] == [["x"], ["y"]]


def test_a_stopped_run_goes_on(spark, tmp_path):
    root, broken = str(tmp_path), {"at": 1}
    expand = links_of(spark, PAIRS)

    def fails(new):
        broken["at"] -= 1
        if broken["at"] < 0:
            raise RuntimeError("stopped here")
        return expand(new)

    follow.add_seeds(spark.createDataFrame([("a",)], "target string"), root)
    with pytest.raises(Exception, match="stopped here"):
        follow.follow(spark, root, fails, None)
    assert depths(follow.follow(spark, root, expand, None)) == {"a": 0, "b": 1, "long1": 1, "c": 2, "d": 2, "long2": 2}


def test_engine_follows_local_links(spark, tmp_path):
    from folia.plans.engine import Engine

    docs = [("/k/a.md", None, "# A\n\nsee [b](sub/b.md) and [out](http://x.y/)"), ("/k/sub/b.md", None, "back to [a](../a.md), on to [c](c.html)"), ("/k/sub/c.html", None, "<p><a href='/k/d.txt'>d</a></p>"), ("/k/d.txt", None, "end"), ("/k/e.md", None, "alone")]
    contents = spark.createDataFrame(docs, "source_id string, doc_type string, content string")
    e = Engine(spark, str(tmp_path / "store"))
    got = e.crawl(contents, spark.createDataFrame([("/k/a.md",)], "target string"), str(tmp_path / "crawl"), 2)
    assert depths(got) == {"/k/a.md": 0, "/k/sub/b.md": 1, "/k/sub/c.html": 2}
    assert {r.source_id for r in e.table("documents").collect()} == {"/k/a.md", "/k/sub/b.md", "/k/sub/c.html"}
