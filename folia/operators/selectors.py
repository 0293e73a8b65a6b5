"""CSS selectors and XPath over a relation of markup nodes.

``nodes`` turns HTML or XML into a row per element with its interval label (pre, last),
parent, place among its siblings, tag and attributes.  A selector is compiled to a
chain of steps.  A step marks the nodes that pass its tests and stand in the right
relation to the nodes marked before: below one (a running maximum of the ``last`` of
marked nodes reaches this far), after one among siblings (a running mark), or child
of one (an equi join by parent).  No step pairs nodes with nodes.

CSS: tag, *, #id, .class, [a], [a=v] with =, ~=, |=, ^=, $=, *=, :first-child,
:last-child, :only-child, :nth-child(n), :nth-of-type(n), :first-of-type, :root, and
the combinators blank, >, + and ~, and lists with commas.
XPath: / and //, tag, *, [n], [@a], [@a='v'], [last()], [text()='v'], and at the end
@a or text().
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.markup import _CLOSES, VOID

_FIELDS = [("doc_id", "string"), ("pre", "int"), ("last", "int"), ("depth", "int"), ("parent", "int"), ("place", "int"), ("siblings", "int"), ("of_type", "int"), ("types", "int"), ("tag", "string"), ("attributes", "map<string,string>"), ("own_text", "string"), ("text", "string"), ("selector", "string"), ("xpath", "string")]
DDL = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_ARROW = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])
#: Nodes that a task gathers before it hands them on.
NODES = 4096


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: int | None
    texts: list[tuple[int, str]] = field(default_factory=list)  # (place in the order of texts, text) of its own


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.n_texts = 0

    def handle_starttag(self, tag, attrs):
        for k in range(len(self.open) - 1, -1, -1) if tag in _CLOSES else ():
            at = self.nodes[self.open[k]].tag
            if at in _CLOSES[tag]:
                del self.open[k:]
                break
            if at in ("table", "ul", "ol", "div", "section", "article", "body"):
                break
        self.nodes.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open and data.strip() and self.nodes[self.open[-1]].tag not in ("script", "style"):
            self.nodes[self.open[-1]].texts.append((self.n_texts, data))
            self.n_texts += 1


def html_nodes(html: str | None) -> list[Node]:
    p = _Html()
    p.feed(html or "")
    p.close()
    return p.nodes


def xml_nodes(xml: str | None) -> list[Node]:
    """Names without their namespaces; what can't be read has no nodes."""
    try:
        top = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out: list[Node] = []
    local, texts = (lambda t: t.rpartition("}")[2]), 0
    todo: list[tuple] = [(top, None, None)]
    while todo:
        node, parent, tail = todo.pop()
        if tail is not None:  # what follows a child belongs to its parent
            if tail.strip():
                out[parent].texts.append((texts, tail))
                texts += 1
            continue
        me = len(out)
        out.append(Node(local(node.tag), {local(k): v for k, v in node.attrib.items()}, parent))
        if (node.text or "").strip():
            out[me].texts.append((texts, node.text))
            texts += 1
        for kid in reversed([k for k in node if isinstance(k.tag, str)]):
            todo += [(None, me, kid.tail or ""), (kid, me, None)]
    return out


def labelled(doc_id: str, nodes: list[Node]) -> list[tuple]:
    """The rows of one document, in document order."""
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, -1, -1):
        if (up := nodes[i].parent) is not None:
            last[up] = max(last[up], last[i])
    kids, typed = Counter(n.parent for n in nodes), Counter((n.parent, n.tag) for n in nodes)
    seen, of_tag, depth, css, xpath, out = Counter(), Counter(), [], [], [], []
    text = [None] * len(nodes)
    pieces: list[list[tuple[int, str]]] = [[*n.texts] for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        joined = sorted(pieces[i])
        text[i] = " ".join(" ".join(t for _, t in joined).split())
        if (up := nodes[i].parent) is not None and joined:
            pieces[up].append((joined[0][0], " ".join(t for _, t in joined)))
        pieces[i] = []
    for i, n in enumerate(nodes):
        up = n.parent
        seen[up] += 1
        of_tag[up, n.tag] += 1
        depth.append(0 if up is None else depth[up] + 1)
        css.append(f"{n.tag}:nth-of-type({of_tag[up, n.tag]})" if up is None else f"{css[up]} > {n.tag}:nth-of-type({of_tag[up, n.tag]})")
        xpath.append(f"{'' if up is None else xpath[up]}/{n.tag}[{of_tag[up, n.tag]}]")
        own = " ".join(" ".join(t for _, t in n.texts).split())
        out.append((doc_id, i, last[i], depth[i], up, seen[up], kids[up], of_tag[up, n.tag], typed[up, n.tag], n.tag, list(n.attributes.items()), own, text[i], css[i], xpath[i]))
    return out


def nodes(docs: DataFrame, kind: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """A row per element of every row of ``docs``; ``kind`` is html or xml.

    selector and xpath are addresses of the element: each finds it alone in its document.
    """
    parse = {"html": html_nodes, "xml": xml_nodes}[kind]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += labelled(doc, parse(content))
                while len(rows) >= NODES:
                    yield table(rows[:NODES])
                    rows = rows[NODES:]
        if rows:
            yield table(rows)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, DDL)


@dataclass(frozen=True)
class Step:
    """How a node stands to one marked before (any, below, child, next or after), and what it must be."""

    axis: str
    tests: tuple[Column, ...]


_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z_][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[\w-]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\(\s*(?P<n>\d+)\s*\))?""", re.X)
_PSEUDO = {
    "first-child": lambda n: F.col("place") == 1, "last-child": lambda n: F.col("place") == F.col("siblings"), "only-child": lambda n: F.col("siblings") == 1, "nth-child": lambda n: F.col("place") == n,
    "first-of-type": lambda n: F.col("of_type") == 1, "last-of-type": lambda n: F.col("of_type") == F.col("types"), "nth-of-type": lambda n: F.col("of_type") == n, "root": lambda n: F.col("depth") == 0,
}


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


def _attribute(name: str, op: str | None, value: str) -> Column:
    a, v = F.col("attributes")[name], F.lit(value)
    if op is None:
        return a.isNotNull()
    if op in ("^=", "$=", "*=") and not value:
        return F.lit(False)
    return {"=": a == v, "~=": F.array_contains(_words(a), v), "|=": (a == v) | a.startswith(value + "-"), "^=": a.startswith(value), "$=": a.endswith(value), "*=": a.contains(value)}[op]


def _compound(text: str) -> tuple[Column, ...]:
    at, tests = 0, []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m["tag"] and at:
            raise ValueError(f"can't read {text[at:]!r} in a selector")
        at = m.end()
        if m["tag"]:
            tests += [F.col("tag") == m["tag"]] if m["tag"] != "*" else []
        elif m["id"]:
            tests.append(F.col("attributes")["id"] == m["id"])
        elif m["cls"]:
            tests.append(F.array_contains(_words(F.col("attributes")["class"]), m["cls"]))
        elif m["name"]:
            tests.append(_attribute(m["name"], m["op"], next((m[k] for k in ("d", "s", "bare") if m[k] is not None), "")))
        elif m["pseudo"] in _PSEUDO:
            tests.append(_PSEUDO[m["pseudo"]](int(m["n"] or 0)))
        else:
            raise ValueError(f"can't read :{m['pseudo']} in a selector")
    return tuple(tests)


def _cut(text: str, at: str) -> list[str]:
    """Pieces between the separators that stand outside brackets and quotes."""
    piece = rf"""(?:[^{at}\[("']|\[(?:[^\]"']|"[^"]*"|'[^']*')*\]|\([^)]*\))+"""
    if re.sub(rf"{piece}|[{at}]", "", text):
        raise ValueError(f"can't read {text!r}: brackets or quotes don't close")
    return re.findall(piece, text)


def css(selector: str) -> list[list[Step]]:
    """The chains of steps of a list of selectors."""
    out = []
    for one in _cut(selector, ","):
        spaced = re.sub(r"\s*([>+~])(?!=)\s*(?![^\[]*\])", r" \1 ", one.strip())
        axis, chain = "any", []
        for word in _cut(spaced, r"\s"):
            if word in (">", "+", "~"):
                axis = {">": "child", "+": "next", "~": "after"}[word]
                continue
            chain.append(Step(axis, _compound(word)))
            axis = "below"
        if not chain or axis != "below":
            raise ValueError(f"can't read the selector {selector!r}")
        out.append(chain)
    if not out:
        raise ValueError("an empty selector")
    return out


_XSTEP = re.compile(r"(?P<axis>//?)(?:(?P<text>text\(\))|@(?P<attr>[\w:-]+)|(?:[\w-]+:)?(?P<tag>\*|[\w.-]+))(?P<tests>(?:\[(?:[^\]'\"]|'[^']*'|\"[^\"]*\")*\])*)")
_XTEST = re.compile(r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|@(?P<attr>[\w:-]+)\s*(?:=\s*(?P<v>'[^']*'|"[^"]*"))?|text\(\)\s*=\s*(?P<t>'[^']*'|"[^"]*"))\s*\]""")


def xpath(path: str) -> tuple[list[Step], str | None]:
    """(the chain of steps, what is asked of the nodes: text(), an attribute's name after @, or None)."""
    at, chain, asked = 0, [], None
    while at < len(path):
        m = _XSTEP.match(path, at)
        if not m or asked:
            raise ValueError(f"can't read {path[at:]!r} in a path")
        at = m.end()
        if m["text"] or m["attr"]:
            asked = "text()" if m["text"] else f"@{m['attr']}"
            if m["axis"] == "//" or m["tests"]:
                raise ValueError(f"can't read {path!r}")
            continue
        axis = ("any" if m["axis"] == "//" else "top") if not chain else ("below" if m["axis"] == "//" else "child")
        star, tests = m["tag"] == "*", [] if m["tag"] == "*" else [F.col("tag") == m["tag"]]
        rest = m["tests"]
        while rest:
            t = _XTEST.match(rest)
            if not t:
                raise ValueError(f"can't read {rest!r} in a path")
            rest = rest[t.end() :]
            if t["n"] or t["last"]:
                if len(tests) > (not star):
                    raise ValueError(f"a place after another test isn't read: {path!r}")
                place, count = ("place", "siblings") if star else ("of_type", "types")
                tests.append(F.col(place) == (int(t["n"]) if t["n"] else F.col(count)))
            elif t["attr"]:
                tests.append(_attribute(t["attr"], "=" if t["v"] else None, (t["v"] or "''")[1:-1]))
            else:
                tests.append(F.col("own_text") == t["t"][1:-1])
        if axis == "top":
            tests.append(F.col("depth") == 0)
        chain.append(Step("any" if axis == "top" else axis, tuple(tests)))
    if not chain:
        raise ValueError(f"can't read the path {path!r}")
    return chain, asked


def _marked(rows: DataFrame, chain: list[Step]) -> DataFrame:
    """``rows`` with the column _mark: whether the chain ends at the node."""
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy("doc_id", "parent").orderBy("place")
    for k, step in enumerate(chain):
        fits = reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in step.tests), F.lit(True))
        if step.axis == "any":
            stands = F.lit(True)
        elif step.axis == "below":
            stands = F.max(F.when(F.col("_mark"), F.col("last"))).over(before) >= F.col("pre")
        elif step.axis == "next":
            stands = F.lag("_mark").over(among)
        elif step.axis == "after":
            stands = F.max("_mark").over(among.rowsBetween(Window.unboundedPreceding, -1))
        else:
            up = rows.where("_mark").select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("_up"))
            rows, stands = rows.join(up, ["doc_id", "parent"], "left"), F.col("_up")
        rows = rows.withColumn("_mark", fits & F.coalesce(stands, F.lit(False))).drop("_up")
    return rows


def select(rows: DataFrame, selector: str) -> DataFrame:
    """The nodes that a CSS selector finds in their documents, each once."""
    chains = [_marked(rows, c).where("_mark").drop("_mark") for c in css(selector)]
    if len(chains) == 1:
        return chains[0]
    keys = reduce(DataFrame.unionByName, (c.select("doc_id", "pre") for c in chains)).distinct()
    return rows.join(keys, ["doc_id", "pre"], "left_semi").select(rows.columns)


def select_xpath(rows: DataFrame, path: str) -> DataFrame:
    """The nodes that an XPath finds, with ``value``: the text or attribute asked for, else the whole text."""
    chain, asked = xpath(path)
    got = _marked(rows, chain).where("_mark").drop("_mark")
    if asked is None:
        return got.withColumn("value", F.col("text"))
    value = F.nullif(F.col("own_text"), F.lit("")) if asked == "text()" else F.col("attributes")[asked[1:]]
    return got.withColumn("value", value).where("value is not null")


def look_up(pointers: DataFrame, rows: DataFrame) -> DataFrame:
    """``pointers`` (doc_id, address) with pre and text of the node at the address, a selector or XPath as ``nodes`` makes them; null where there is none.

    Many pointers are one equi join by document and address.
    """
    named = rows.select("doc_id", F.explode(F.array("selector", "xpath")).alias("address"), "pre", "text")
    return pointers.select("doc_id", "address").join(named, ["doc_id", "address"], "left")
