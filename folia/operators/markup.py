"""HTML, XML and office documents to elements, where only a parser will do.

Each is a table function over Arrow batches: one input row, many output rows of
doc_id, ord, element_type, parent_ord, parent_type, content, metadata.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.operators.office import docx_elements, pptx_elements, xlsx_elements

SCHEMA = pa.schema([("doc_id", pa.string()), ("ord", pa.int32()), ("element_type", pa.string()), ("parent_ord", pa.int32()), ("parent_type", pa.string()), ("content", pa.string()), ("metadata", pa.string())])
DDL = "doc_id string, ord int, element_type string, parent_ord int, parent_type string, content string, metadata string"

# The tags that become elements, and what they are called.
TAGS = {
    "p": "paragraph", "h1": "header", "h2": "header", "h3": "header", "h4": "header", "h5": "header", "h6": "header", "ul": "list", "ol": "list", "li": "list_item", "table": "table",
    "tr": "table_row", "td": "table_cell", "th": "table_header", "pre": "code_block", "code": "code_block", "blockquote": "blockquote", "img": "image", "div": "div", "article": "article",
    "section": "section", "nav": "nav", "aside": "aside", "figure": "figure",
}
VOID = {"img", "br", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Html(HTMLParser):
    """Collects the structural elements below the body; other tags are transparent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = [{"type": "root", "parent": None, "text": [], "meta": {}}]
        self.open: list[tuple[str, int]] = []
        self.skip = 0

    def _parent(self) -> int:
        return next((i for _, i in reversed(self.open) if i >= 0), 0)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += tag != "head"
            return
        if tag in _CLOSES:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in _CLOSES[tag]:
                    del self.open[k:]
                    break
                if self.open[k][0] in TAGS:
                    break
        attrs = dict(attrs)
        if tag in TAGS:
            meta = {k: attrs[k] for k in ("id", "class", "src", "alt") if attrs.get(k)}
            if TAGS[tag] == "header":
                meta["level"] = int(tag[1])
            if tag in ("td", "th"):
                meta |= {k: int(v) for k in ("rowspan", "colspan") if (v := attrs.get(k) or "").isdigit()}
            if tag in ("ul", "ol"):
                meta["list_type"] = "ordered" if tag == "ol" else "unordered"
            self.rows.append({"type": TAGS[tag], "parent": self._parent(), "text": [], "meta": meta, "keep": tag in ("img", "table")})
        if tag == "a" and attrs.get("href"):
            for _, i in self.open:
                if i >= 0:
                    self.rows[i]["meta"].setdefault("links", []).append(attrs["href"])
        if tag not in VOID:
            self.open.append((tag, len(self.rows) - 1 if tag in TAGS else -1))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.skip and data.strip():
            for _, i in self.open:
                if i >= 0:
                    self.rows[i]["text"].append(data)


def _place_cells(rows: list[dict]) -> None:
    """Row, column and extent of every table cell: a cell takes the first place of its row that no cell above or before covers."""
    lines: dict[int, list[int]] = {}  # table -> its rows, row -> its cells
    for i, r in enumerate(rows):
        if r["type"] in ("table_row", "table_cell", "table_header"):
            lines.setdefault(r["parent"], []).append(i)
    for i, r in enumerate(rows):
        if r["type"] != "table":
            continue
        mine = [k for k in lines.get(i, []) if rows[k]["type"] == "table_row"]
        covered: dict[int, int] = {}  # column -> the last row that a cell from above covers
        for n, line in enumerate(mine):
            col = 0
            for k in lines.get(line, []):
                meta = rows[k]["meta"]
                while covered.get(col, -1) >= n:
                    col += 1
                wide, tall = max(1, min(meta.get("colspan", 1), 1000)), meta.get("rowspan", 1)
                tall = len(mine) - n if tall == 0 else min(tall, len(mine) - n)  # 0 goes to the table's end
                for c in range(col, col + wide):
                    covered[c] = n + tall - 1
                rows[k]["meta"] = {x: y for x, y in meta.items() if x not in ("rowspan", "colspan")} | {"row": n, "col": col} | ({"colspan": wide} if wide > 1 else {}) | ({"rowspan": tall} if tall > 1 else {})
                col += wide


def html_elements(html: str | None) -> list[tuple]:
    p = _Html()
    p.feed(html or "")
    p.close()
    _place_cells(p.rows)
    out, place = [], {}
    for i, r in enumerate(p.rows):
        text = " ".join(" ".join(r.pop("text")).split())
        if i and not text and not r.get("keep"):
            continue  # empty elements give no row; their children move up
        parent = r["parent"]
        while parent is not None and parent not in place:
            parent = p.rows[parent]["parent"]
        place[i] = len(out)
        out.append((len(out), r["type"], None if parent is None else place[parent], text if i else None, json.dumps(r["meta"], sort_keys=True) if r["meta"] else None))
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_elements(xml: str | None) -> list[tuple]:
    """Every element as xml_list, xml_object or xml_element, and texts as xml_text; broken input is a root alone."""
    out: list[tuple] = [(0, "root", None, None, None)]
    try:
        top = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError as e:
        return [(0, "root", None, None, json.dumps({"error": str(e)}))]
    todo = [(top, 0, "/" + _local(top.tag))]
    while todo:
        node, parent, path = todo.pop()
        kids = list(node)
        tags = [_local(k.tag) for k in kids]
        common = max((tags.count(t) for t in set(tags)), default=0)
        kind = "xml_element" if not kids else "xml_list" if len(set(tags)) == 1 and len(tags) > 1 or common > 0.8 * len(tags) and len(tags) > 1 else "xml_object"
        me = len(out)
        out.append((me, kind, parent, (node.text or "").strip() or None, json.dumps({"path": path, "attributes": {_local(k): v for k, v in node.attrib.items()}}, sort_keys=True)))
        if (node.text or "").strip():
            out.append((len(out), "xml_text", me, node.text.strip(), json.dumps({"path": path + "/text()"})))
        seen: dict[str, int] = {}
        below = []
        for k, t in zip(kids, tags, strict=True):
            seen[t] = seen.get(t, 0) + 1
            below.append((k, me, f"{path}/{t}[{seen[t]}]"))
        todo += reversed(below)
    return out


def csv_table(text: str) -> list[list[str]]:
    """The rows of a CSV text; the dialect is had from its start, a mark of byte order, blank lines and spaces around cells go."""
    text = text.lstrip("\ufeff").lstrip("\r\n")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",\t;|")
    except csv.Error:
        dialect = csv.excel
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=dialect.delimiter, quotechar=dialect.quotechar or '"', skipinitialspace=True)
    return [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]


def csv_elements(text: str | None) -> list[tuple]:
    """root, table, a header row (its names in the metadata), rows and cells."""
    out: list[tuple] = [(0, "root", None, None, None)]
    rows = csv_table(text or "")
    if not rows:
        return out
    out.append((1, "table", 0, None, json.dumps({"columns": len(rows[0]), "rows": len(rows) - 1})))
    out.append((2, "table_header_row", 1, ", ".join(rows[0]), json.dumps({"values": rows[0]})))
    for r, row in enumerate(rows[1:], 1):
        at = len(out)
        out.append((at, "table_row", 1, ", ".join(row), json.dumps({"row": r})))
        out += [(at + 1 + c, "table_cell", at, v, json.dumps({"row": r, "col": c, "header": rows[0][c] if c < len(rows[0]) else f"column_{c + 1}"})) for c, v in enumerate(row)]
    return out


def json_elements(text: str | None) -> list[tuple]:
    """root, then json_object, json_field, json_array and json_item by structure, each with its path; broken input is a root alone."""
    out: list[tuple] = [(0, "root", None, None, None)]
    try:
        top = json.loads(text or "")
    except ValueError as e:
        return [(0, "root", None, None, json.dumps({"error": str(e)}))]
    plain = lambda v: v if isinstance(v, str) else json.dumps(v)
    todo: list[tuple] = [(top, 0, "$", None)]
    while todo:
        value, parent, path, name = todo.pop()
        me = len(out)
        kind = "json_object" if isinstance(value, dict) else "json_array" if isinstance(value, list) else "json_field" if name is not None else "json_item"
        out.append((me, kind, parent, None if kind in ("json_object", "json_array") else plain(value), json.dumps({"json_path": path, **({"name": name} if name is not None else {})})))
        if isinstance(value, dict):
            todo += reversed([(v, me, f"{path}.{k}", k) for k, v in value.items()])
        elif isinstance(value, list):
            todo += reversed([(v, me, f"{path}[{i}]", None) for i, v in enumerate(value)])
    return out


def pdf_elements(data: bytes) -> list[tuple]:
    """root, page_content, pages and their lines of text: headers where the font is large, else paragraphs.

    Reads text of plain and Flate streams with simple fonts; what it can't read gives a page without lines.
    """
    out: list[tuple] = [(0, "root", None, None, None), (1, "page_content", 0, None, None)]
    page = 0
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        page += 1
        at = len(out)
        out.append((at, "page", 1, None, json.dumps({"page": page})))
        size, line = 0.0, ""

        def put() -> None:
            nonlocal line
            if line.strip():
                out.append((len(out), "header" if size >= 14 else "paragraph", at, " ".join(line.split()), json.dumps({"font_size": size})))
            line = ""

        for x in re.finditer(rb"/\S+\s+([\d.]+)\s+Tf|(\((?:\\.|[^\\()])*\))\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|Td|TD|Tm|ET)", raw, re.S):
            if x.group(4):
                put()
            elif x.group(1):
                size = float(x.group(1))
            else:
                for s in [x.group(2)] if x.group(2) else re.findall(rb"\((?:\\.|[^\\()])*\)", x.group(3)):
                    line += re.sub(rb"\\([()\\])", rb"\1", s[1:-1]).decode("latin-1")
        put()
    return out


PARSERS = {"html": html_elements, "xml": xml_elements, "docx": docx_elements, "pptx": pptx_elements, "xlsx": xlsx_elements, "csv": csv_elements, "json": json_elements, "pdf": pdf_elements}
#: Elements that go on together, of one document or several.
BATCH = 4096
#: Formats whose parsers take bytes.
BINARY = ("docx", "pptx", "xlsx", "pdf")

# Attributes of XML that name a link, and those whose links are of kind link.
LINK_ATTRIBUTES = ("href", "src", "link", "url", "uri", "ref", "reference", "target", "source", "resource", "location")
PLAIN_LINKS = ("href", "src")


def markup_links(rows: DataFrame) -> DataFrame:
    """doc_id, ord, link_target, link_type of parsed rows: html and office links, and XML attributes that name one."""
    html = F.transform(F.from_json(F.get_json_object("metadata", "$.links"), "array<string>"), lambda u: F.struct(u.alias("link_target"), F.lit("link").alias("link_type")))
    attrs = [F.struct(F.get_json_object("metadata", f"$.attributes.{a}").alias("link_target"), F.lit("link" if a in PLAIN_LINKS else "referenced_by").alias("link_type")) for a in LINK_ATTRIBUTES]
    xml = F.filter(F.array(*attrs), lambda x: x["link_target"].isNotNull())
    return rows.select("doc_id", "ord", F.inline(F.concat(F.coalesce(html, F.array().cast("array<struct<link_target:string,link_type:string>>")), xml)))


def explode_markup(docs: DataFrame, kind: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """The elements of every row; a document that can't be read gives a root with its error."""
    binary = F.col(content_col) if kind in BINARY else F.lit(None).cast("binary")
    text = F.lit(None).cast("string") if kind in BINARY else F.col(content_col)
    return _exploded(docs.select(F.col(id_col).cast("string"), F.lit(kind), text, binary))


def explode_mixed(docs: DataFrame) -> DataFrame:
    """The elements of documents of all these formats (doc_id, doc_type, content, perhaps bytes), read once."""
    binary = F.col("bytes") if "bytes" in docs.columns else F.lit(None).cast("binary")
    return _exploded(docs.select(F.col("doc_id").cast("string"), "doc_type", "content", binary))


def _exploded(docs: DataFrame) -> DataFrame:
    """docs: id, kind, text, bytes."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    def elements(doc, kind, text, binary):
        try:
            got = PARSERS[kind](binary if kind in BINARY else text)
        except Exception as e:
            got = [(0, "root", None, None, json.dumps({"error": f"{type(e).__name__}: {e}"}))]
        for i, kind_, up, said, meta in got:
            yield doc, i, kind_, up, None if up is None else got[up][1], said, meta

    def run(batches):
        for b in batches:
            rows = []
            for at in range(b.num_rows):  # one document's elements at a time
                for row in elements(*(c[at].as_py() for c in b.columns)):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return docs.toDF("id", "kind", "text", "bytes").mapInArrow(run, DDL)
