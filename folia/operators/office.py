"""Office files as elements: the parts of a package are found through its relationships.

A package names its parts by ids in ``_rels`` files, so the order of slides, the
names of sheets, headers, footers, notes, comments and links come from there and
not from the names of files.  Each function takes the bytes of a file and gives
(place, type, parent's place, text, metadata as JSON) in document order.
"""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, part: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(part)) if part in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (the last word of the relationship's type, the part or outside address that it names)."""
        folder, name = posixpath.split(part)
        top, out = self.xml(posixpath.join(folder, "_rels", f"{name}.rels")), {}
        for r in top if top is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target)
        return out

    def related(self, part: str, kind: str) -> list[str]:
        """The parts of a kind that a part names, each once."""
        return list(dict.fromkeys(t for k, t in self.relations(part).values() if k == kind and t in self.names))

    def main(self, usual: str) -> str:
        return next(iter(self.related("", "officeDocument")), usual)


class Rows(list):
    def put(self, kind: str, parent: int | None, text: str | None = None, /, **meta) -> int:
        meta = {k: v for k, v in meta.items() if v not in (None, [])}
        self.append((len(self), kind, parent, text, json.dumps(meta, ensure_ascii=False) if meta else None))
        return len(self) - 1


def _said(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag)).strip()


def _levels(styles: ElementTree.Element | None) -> dict[str, int]:
    """Style id -> heading level; a style without one takes that of the style it is based on."""
    base, own = {}, {}
    for s in styles.iter(_W + "style") if styles is not None else ():
        key, name = s.get(_W + "styleId", ""), s.find(_W + "name")
        up, outline = s.find(_W + "basedOn"), s.find(f"{_W}pPr/{_W}outlineLvl")
        base[key] = up.get(_W + "val") if up is not None else None
        level = _named_level(name.get(_W + "val", "") if name is not None else "") or _named_level(key)
        if not level and outline is not None and outline.get(_W + "val", "9").isdigit() and int(outline.get(_W + "val", "9")) < 9:
            level = int(outline.get(_W + "val")) + 1
        own[key] = level
    out = {}
    for key in own:
        at, seen = key, set()
        while at and at not in seen and not own.get(at):
            seen.add(at)
            at = base.get(at)
        out[key] = own.get(at, 0) if at not in seen else 0
    return out


def _named_level(name: str) -> int:
    name = name.lower().replace(" ", "")
    if name in ("title", "subtitle"):
        return 1 if name == "title" else 2
    return int(name[7:]) if name.startswith("heading") and name[7:].isdigit() else 0


def docx_elements(data: bytes) -> list[tuple]:
    """root; the body with headers by style, paragraphs, list items and tables; then page headers, page footers and comments."""
    package, out = Package(data), Rows()
    part = package.main("word/document.xml")
    links = package.relations(part)
    levels = _levels(next((package.xml(p) for p in package.related(part, "styles")), None))
    top = package.xml(part)
    if top is None:
        raise KeyError(f"no part {part}")
    out.put("root", None)
    body, stack = out.put("body", 0), []

    def targets(node, names) -> list[str]:
        got = [names[h.get(_R + "id")][1] if h.get(_R + "id") in names else f"#{h.get(_W + 'anchor')}" if h.get(_W + "anchor") else None for h in node.iter(_W + "hyperlink")]
        return [g for g in got if g]

    for node in top.find(_W + "body") if top.find(_W + "body") is not None else ():
        parent = stack[-1][1] if stack else body
        if node.tag == _W + "p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name, text, to = style.get(_W + "val", "") if style is not None else "", _said(node, _W + "t"), targets(node, links)
            if not text:
                continue
            level = levels.get(name) or _named_level(name)
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, out.put("header", stack[-1][1] if stack else body, text, level=level, text=text, links=to)))
            else:
                out.put("list_item" if node.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph", parent, text, links=to)
        elif node.tag == _W + "tbl":
            table = out.put("table", parent)
            for r, row in enumerate(node.iter(_W + "tr")):
                at, col = out.put("table_row", table, row=r), 0
                for cell in row.findall(_W + "tc"):
                    span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                    wide = int(span.get(_W + "val", "1")) if span is not None else 1
                    out.put("table_cell", at, _said(cell, _W + "t"), row=r, col=col, colspan=wide if wide > 1 else None, links=targets(cell, links))
                    col += wide
    for kind, box, item in (("header", "headers", "page_header"), ("footer", "footers", "page_footer")):
        texts = [(p, _said(x, _W + "t"), targets(x, package.relations(p))) for p in package.related(part, kind) for x in package.xml(p).iter(_W + "p")]
        if any(t for _, t, _ in texts):
            at = out.put(box, 0)
            for p, text, to in texts:
                if text:
                    out.put(item, at, text, part=p, links=to)
    said = [c for p in package.related(part, "comments") for c in package.xml(p).iter(_W + "comment")]
    if said:
        at = out.put("comments", 0)
        for c in said:
            out.put("comment", at, _said(c, _W + "t"), author=c.get(_W + "author"), date=c.get(_W + "date"))
    return out


def pptx_elements(data: bytes) -> list[tuple]:
    """root; slides in the order of the presentation with texts, tables, notes and comments; then masters and layouts."""
    package, out = Package(data), Rows()
    part = package.main("ppt/presentation.xml")
    names, top = package.relations(part), package.xml(part)
    order = [names[s.get(_R + "id")][1] for s in top.iter(_P + "sldId") if s.get(_R + "id") in names] if top is not None else []
    if not order:  # a package without a presentation part: by number
        order = sorted((n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    out.put("root", None)
    show = out.put("presentation_body", 0)
    for i, name in enumerate(order):
        if (slide := package.xml(name)) is None:
            continue
        at = out.put("slide", show, index=i)
        _drawn(out, at, slide, package.relations(name))
        for notes in package.related(name, "notesSlide"):
            if text := "\n".join(filter(None, (_said(p, _A + "t") for p in package.xml(notes).iter(_A + "p")))):
                out.put("slide_notes", at, text)
        talk = [c for p in package.related(name, "comments") for c in package.xml(p).iter() if c.tag.endswith("}cm")]
        if talk:
            box = out.put("comments_container", at)
            for c in talk:
                out.put("comment", box, "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}text", "}t"))).strip())
    masters = package.related(part, "slideMaster")
    for box, item, parts in (("slide_masters", "slide_master", masters), ("slide_templates", "slide_layout", list(dict.fromkeys(p for m in masters for p in package.related(m, "slideLayout"))))):
        if parts:
            at = out.put(box, 0)
            for p in parts:
                named = package.xml(p).find(_P + "cSld")
                _drawn(out, out.put(item, at, named.get("name") if named is not None else None, part=p), package.xml(p), package.relations(p))
    return out


def _drawn(out: Rows, at: int, page: ElementTree.Element, names: dict[str, tuple[str, str]]) -> None:
    """Texts and tables of a slide, in their order."""
    in_table = {id(p) for t in page.iter(_A + "tbl") for p in t.iter(_A + "p")}
    links = lambda node: [names[h.get(_R + "id")][1] for h in node.iter(_A + "hlinkClick") if h.get(_R + "id") in names]
    for node in page.iter():
        if node.tag == _A + "p" and id(node) not in in_table:
            if text := _said(node, _A + "t"):
                out.put("text_box", at, text, links=links(node))
        elif node.tag == _A + "tbl":
            table = out.put("table", at)
            for r, row in enumerate(node.findall(_A + "tr")):
                line = out.put("table_row", table, row=r)
                for c, cell in enumerate(row.findall(_A + "tc")):
                    if cell.get("hMerge") != "1" and cell.get("vMerge") != "1":  # a merged-over cell is part of another
                        tall, wide = (int(cell.get(k, "1")) for k in ("rowSpan", "gridSpan"))
                        out.put("table_cell", line, _said(cell, _A + "t"), row=r, col=c, rowspan=tall if tall > 1 else None, colspan=wide if wide > 1 else None, links=links(cell))


def address(ref: str) -> tuple[int, int]:
    """(row, column) of a cell's address, both from 1."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = 26 * col + ord(c) - ord("A") + 1
    return int(digits), col


# Built-in number formats that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(styles: ElementTree.Element | None) -> set[int]:
    """The cell styles whose number format shows a date or a time."""
    if styles is None:
        return set()
    own = {int(f.get("numFmtId", "0")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(_S + "numFmt")}
    dated = _DATE_FORMATS | {i for i, code in own.items() if re.search(r"[ymdhs]", code, re.I) and not re.search(r"general", code, re.I)}
    cells = styles.find(_S + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", "0")) in dated}


def _dated(serial: str) -> str:
    """A day's number as an ISO date, with the time where it has one."""
    try:
        at = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(float(serial) * 86_400))
    except (ValueError, OverflowError):
        return serial
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ")


def xlsx_elements(data: bytes) -> list[tuple]:
    """root, workbook, sheets in their order, rows and cells; the first row of a sheet holds its headers.

    A cell has its address and place; a merged one its extent, a computed one its formula.
    """
    package, out = Package(data), Rows()
    part = package.main("xl/workbook.xml")
    names, book = package.relations(part), package.xml(part)
    shared_part = next(iter(package.related(part, "sharedStrings")), "xl/sharedStrings.xml")
    shared = [_said(s, _S + "t") for s in top.iter(_S + "si")] if (top := package.xml(shared_part)) is not None else []
    dated = _date_styles(next((package.xml(p) for p in package.related(part, "styles")), None))
    sheets = [(s.get("name"), names[s.get(_R + "id")][1]) for s in book.iter(_S + "sheet") if s.get(_R + "id") in names] if book is not None else []
    if not sheets:  # a workbook without relationships: by number
        files = sorted((n for n in package.names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        said = [s.get("name") for s in book.iter(_S + "sheet")] if book is not None else []
        sheets = [(said[i] if i < len(said) else n, n) for i, n in enumerate(files)]
    out.put("root", None)
    at_book = out.put("workbook", 0)
    for i, (title, name) in enumerate(sheets):
        if (page := package.xml(name)) is None:
            continue
        sheet, links = out.put("sheet", at_book, title, index=i), package.relations(name)
        merged = {}
        for m in page.iter(_S + "mergeCell"):
            first, _, last = m.get("ref", "").partition(":")
            (r0, c0), (r1, c1) = address(first), address(last or first)
            merged[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1, m.get("ref"))
        to = {h.get("ref"): links[h.get(_R + "id")][1] if h.get(_R + "id") in links else f"#{h.get('location')}" for h in page.iter(_S + "hyperlink")}
        for row in page.iter(_S + "row"):
            cells = []
            for c in row.findall(_S + "c"):
                v, inline, f = c.find(_S + "v"), c.find(f"{_S}is"), c.find(_S + "f")
                text = _said(inline, _S + "t") if inline is not None else None if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if text and c.get("t", "n") == "n" and c.get("s", "").isdigit() and int(c.get("s")) in dated:
                    text = _dated(text)
                formula = f.text if f is not None else None
                if text or formula:
                    cells.append((c.get("r"), text, formula))
            if cells:
                head = row.get("r") == "1"
                at = out.put("table_header_row" if head else "table_row", sheet, row=int(row.get("r") or 0))
                for ref, text, formula in cells:
                    r, col = address(ref) if ref else (None, None)
                    tall, wide, _ = merged.get((r, col), (1, 1, None))
                    out.put("table_header" if head else "table_cell", at, text, cell=ref, row=r, col=col, rowspan=tall if tall > 1 else None, colspan=wide if wide > 1 else None, formula=formula, links=[to[ref]] if ref in to else [])
        if merged:
            box = out.put("merged_cells", sheet, count=len(merged))
            for (r, col), (tall, wide, ref) in merged.items():
                out.put("merged_cell", box, ref, row=r, col=col, rowspan=tall, colspan=wide)
    return out
