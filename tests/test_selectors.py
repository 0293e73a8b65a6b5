"""Selectors and paths against an evaluator that tries every chain of nodes."""

import os

import pytest
from pyspark.sql import functions as F

from folia.operators import selectors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HTML = """<html><body id=top><div class="a b"><p>one <b>bold</b> two</p><p lang="en-GB" data-k="x y">three</p><img src="i.png"><div><p>deep</p><ul><li>x<li class=a>y</ul></div></div>
<section><h2>T</h2><p>s1</p><span>q</span><p>s2</p><p class="a">s3</p></section><script>var p = '<p>';</script></body></html>"""
XML = "<lib xmlns:k='urn:k'><k:book id='1'><title>A</title><price>3</price></k:book><book id='2' k:lang='de'><title>B</title>tail</book><shelf><book id='3'><title>A</title></book></shelf></lib>"


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([("h", HTML), ("e", ""), ("n", None), ("u", "</p>x<p>loose<p>two")], "doc_id string, content string")
    return selectors.nodes(df, "html").cache()


def test_nodes(pages):
    rows = {r.pre: r for r in pages.where("doc_id = 'h'").collect()}
    assert [rows[i].tag for i in sorted(rows)][:6] == ["html", "body", "div", "p", "b", "p"]
    p = rows[3]
    assert (p.text, p.own_text, p.place, p.siblings, p.of_type, p.types, p.last, p.parent) == ("one bold two", "one two", 1, 4, 1, 2, 4, 2)
    assert rows[2].text == "one bold two three deep x y" and rows[2].attributes == {"class": "a b"}
    assert {r.doc_id for r in pages.collect()} == {"h", "u"}


def fits(node, compound):
    tag, *tests = compound
    return tag in ("*", node.tag) and all(t(node) for t in tests)


def brute(rows, chain):
    """Nodes at which a chain [(axis, compound), ...] ends."""
    by = {r.pre: r for r in rows}

    def before(n, axis):
        if axis == "child":
            return [by[n.parent]] if n.parent is not None else []
        if axis == "below":
            return [r for r in rows if r.pre < n.pre <= r.last]
        same = [r for r in rows if r.parent == n.parent and r.place < n.place]
        return same if axis == "after" else [r for r in same if r.place == n.place - 1]

    def ends(n, k):
        axis, compound = chain[k]
        return fits(n, compound) and (k == 0 or any(ends(b, k - 1) for b in before(n, axis)))

    return {n.pre for n in rows if ends(n, len(chain) - 1)}


CLASS = lambda c: lambda n: c in n.attributes.get("class", "").split()
CASES = [
    ("p", [("any", ["p"])]), ("div p", [("any", ["div"]), ("below", ["p"])]), ("div > p", [("any", ["div"]), ("child", ["p"])]), ("h2 + p", [("any", ["h2"]), ("next", ["p"])]), ("h2~p", [("any", ["h2"]), ("after", ["p"])]),
    (".a", [("any", ["*", CLASS("a")])]), ("div.a.b li.a", [("any", ["div", CLASS("a"), CLASS("b")]), ("below", ["li", CLASS("a")])]), ("#top > section *", [("any", ["*", lambda n: n.attributes.get("id") == "top"]), ("child", ["section"]), ("below", ["*"])]),
    ("[src]", [("any", ["*", lambda n: "src" in n.attributes])]), ("p[lang|=en]", [("any", ["p", lambda n: n.attributes.get("lang", "").startswith("en")])]), ("[data-k~='y']", [("any", ["*", lambda n: "y" in n.attributes.get("data-k", "").split()])]),
    ("img[src$='.png']", [("any", ["img"])]), ("[src^=i][src*=png]", [("any", ["img"])]), ("p:first-child", [("any", ["p", lambda n: n.place == 1])]), ("p:nth-child(2)", [("any", ["p", lambda n: n.place == 2])]), ("section p:nth-of-type(3)", [("any", ["section"]), ("below", ["p", lambda n: n.of_type == 3])]),
    ("div div > ul > li:last-child", [("any", ["div"]), ("below", ["div"]), ("child", ["ul"]), ("child", ["li", lambda n: n.place == n.siblings])]), ("div div div p", [("any", ["div"]), ("below", ["div"]), ("below", ["div"]), ("below", ["p"])]), ("b:only-child", [("any", ["b"])]), (":root", [("any", ["html"])]),
]


@pytest.mark.parametrize(("selector", "chain"), CASES)
def test_selectors_equal_brute_force(pages, selector, chain):
    rows = pages.where("doc_id = 'h'").collect()
    got = [r.pre for r in selectors.select(pages, selector).where("doc_id = 'h'").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, chain)


def test_lists_of_selectors(pages):
    got = sorted(r.text for r in selectors.select(pages, "h2, section > p, p + p, [data-k='x y']").where("doc_id = 'h'").collect())
    assert got == ["T", "s1", "s2", "s3", "three"]
    for bad in ("p >", "p:hover", "", "p[", "a:nth-child(x)"):
        with pytest.raises(ValueError):
            selectors.select(pages, bad)


PATHS = [
    ("/lib/book", ["A 3", "B tail"]), ("//book", ["A 3", "B tail", "A"]), ("//book/title", ["A", "B", "A"]), ("/lib/book[2]/title", ["B"]), ("//book[@id='3']/@id", ["3"]), ("//title[text()='A']", ["A", "A"]), ("/lib/*[1]/price/text()", ["3"]), ("/lib/k:book[last()]/@lang", ["de"]),
    ("/book", []), ("//shelf//title", ["A"]), ("//book[@lang]", ["B tail"]), ("/lib/book[2]/text()", ["tail"]), ("/lib/shelf/text()", []),
]


@pytest.mark.parametrize(("path", "want"), PATHS)
def test_paths(spark, path, want):
    df = spark.createDataFrame([("x", XML), ("broken", "<a><b></a>"), ("n", None)], "doc_id string, content string")
    assert [r.value for r in selectors.select_xpath(selectors.nodes(df, "xml"), path).orderBy("pre").collect()] == want


def test_addresses_find_each_element_alone(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = selectors.nodes(pages, "html", "page_id", "html").cache()
    for address in ("selector", "xpath"):
        got = selectors.look_up(rows.select("doc_id", F.col(address).alias("address"), F.col("pre").alias("asked")), rows)
        assert got.count() == rows.count() and got.where("pre is null").count() == 0
        assert rows.groupBy("doc_id", address).count().where("count > 1").count() == 0
    # the compiled forms of some of them find the same node
    for r in rows.orderBy(F.xxhash64("doc_id", "pre")).limit(3).collect():
        for got in (selectors.select(rows.where(F.col("doc_id") == r.doc_id), r.selector), selectors.select_xpath(rows.where(F.col("doc_id") == r.doc_id), r.xpath)):
            assert [x.pre for x in got.collect()] == [r.pre]
    lost = spark.createDataFrame([("0", "p:nth-of-type(9999)"), ("no page", "/html[1]")], "doc_id string, address string")
    assert [x.pre for x in selectors.look_up(lost, rows).collect()] == [None, None]
