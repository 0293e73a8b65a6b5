"""Packages whose files don't tell their order, links and extents; tables with spans."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from folia.operators import edges, explode, geometry, markup, office

W, A, S, P = (f"http://schemas.openxmlformats.org/{x}/2006/main" for x in ("wordprocessingml", "drawingml", "spreadsheetml", "presentationml"))
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*rows):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Target="{t}" Id="{i}" Type="{R}/{k}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, k, t in rows) + "</Relationships>"


def rows_of(got):
    return [(k, up, text) for _, k, up, text, _ in got]


def test_slides_come_in_the_order_of_the_presentation():
    text = lambda s, link="": f'<a:p><a:r>{link}<a:t>{s}</a:t></a:r></a:p>'
    slide = lambda body: f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld name="n"><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    cell = lambda s, more="": f"<a:tc{more}><a:txBody>{text(s)}</a:txBody></a:tc>"
    deck = package({
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="r7"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r2", "slide", "slides/slide1.xml"), ("r7", "slide", "/ppt/slides/slide10.xml"), ("r9", "slideMaster", "slideMasters/m.xml")),
        "ppt/slides/slide1.xml": slide(text("last")), "ppt/slides/slide10.xml": slide(text("first", '<a:rPr><a:hlinkClick r:id="h"/></a:rPr>') + f'<a:tbl><a:tr>{cell("x", " gridSpan=" + chr(34) + "2" + chr(34))}{cell("", " hMerge=" + chr(34) + "1" + chr(34))}</a:tr><a:tr>{cell("y")}{cell("z")}</a:tr></a:tbl>'),
        "ppt/slides/_rels/slide10.xml.rels": rels(("h", "hyperlink", "http://a.b/c"), ("n", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": slide(text("say this")),
        "ppt/slideMasters/m.xml": slide(text("Click to edit")), "ppt/slideMasters/_rels/m.xml.rels": rels(("l", "slideLayout", "../slideLayouts/l.xml")), "ppt/slideLayouts/l.xml": slide(""),
    })
    got = office.pptx_elements(deck)
    assert rows_of(got) == [
        ("root", None, None), ("presentation_body", 0, None), ("slide", 1, None), ("text_box", 2, "first"), ("table", 2, None), ("table_row", 4, None), ("table_cell", 5, "x"), ("table_row", 4, None), ("table_cell", 7, "y"), ("table_cell", 7, "z"),
        ("slide_notes", 2, "say this"), ("slide", 1, None), ("text_box", 11, "last"), ("slide_masters", 0, None), ("slide_master", 13, "n"), ("text_box", 14, "Click to edit"), ("slide_templates", 0, None), ("slide_layout", 16, "n"),
    ]
    assert json.loads(got[3][4])["links"] == ["http://a.b/c"] and json.loads(got[6][4])["colspan"] == 2


def test_documents_with_headers_comments_links_and_inherited_styles(spark, tmp_path):
    p = lambda s, style="", inner="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}{inner}<w:r><w:t>{s}</w:t></w:r></w:p>'
    style = lambda key, name, base="": f'<w:style w:styleId="{key}"><w:name w:val="{name}"/>{f"<w:basedOn w:val={chr(34)}{base}{chr(34)}/>" if base else ""}</w:style>'
    ns = f'xmlns:w="{W}" xmlns:r="{R}"'
    docx = package({
        "_rels/.rels": rels(("a", "officeDocument", "doc/main.xml")),
        "doc/main.xml": f'<w:document {ns}><w:body>{p("Top", "My1")}{p("see ", "", "<w:hyperlink r:id=" + chr(34) + "h" + chr(34) + "><w:r><w:t>here</w:t></w:r></w:hyperlink>")}{p("Sub", "Deep")}{p("in sub")}<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("ab")}</w:tc><w:tc>{p("c")}</w:tc></w:tr></w:tbl></w:body></w:document>',
        "doc/_rels/main.xml.rels": rels(("h", "hyperlink", "https://x.y/z"), ("s", "styles", "styles.xml"), ("p", "header", "h1.xml"), ("f", "footer", "f1.xml"), ("c", "comments", "c.xml")),
        "doc/styles.xml": f'<w:styles {ns}>{style("H1", "heading 1")}{style("My1", "mine", "H1")}{style("H2", "heading 2")}{style("Deep", "d", "Mid")}{style("Mid", "m", "H2")}{style("Loop", "l", "Loop")}</w:styles>',
        "doc/h1.xml": f"<w:hdr {ns}>{p('Page head')}</w:hdr>", "doc/f1.xml": f"<w:ftr {ns}>{p('Page foot')}</w:ftr>", "doc/c.xml": f'<w:comments {ns}><w:comment w:author="Kim">{p("why?")}</w:comment></w:comments>',
    })
    got = office.docx_elements(docx)
    assert rows_of(got) == [
        ("root", None, None), ("body", 0, None), ("header", 1, "Top"), ("paragraph", 2, "heresee"), ("header", 2, "Sub"), ("paragraph", 4, "in sub"), ("table", 4, None), ("table_row", 6, None), ("table_cell", 7, "ab"), ("table_cell", 7, "c"),
        ("headers", 0, None), ("page_header", 10, "Page head"), ("footers", 0, None), ("page_footer", 12, "Page foot"), ("comments", 0, None), ("comment", 14, "why?"),
    ]
    assert json.loads(got[9][4])["col"] == 2 and json.loads(got[15][4])["author"] == "Kim"
    df = spark.createDataFrame([("d", bytearray(docx))], "doc_id string, content binary")
    rows = markup.explode_markup(df, "docx")
    el = explode.with_ids(rows)
    links = markup.markup_links(rows).join(el.select("doc_id", "ord", F.col("element_id").alias("source_id")), ["doc_id", "ord"]).select("doc_id", "source_id", F.lit(None).cast("string").alias("link_text"), "link_target")
    found = edges.link_edges(links, el).where("relationship_type = 'link'").collect()
    assert [r.target_reference for r in found] == ["https://x.y/z"]


def test_sheets_by_relationship_with_extents_formulas_and_dates():
    ns = f'xmlns="{S}" xmlns:r="{R}"'
    book = package({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Second file" r:id="b"/><sheet name="First file" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "worksheets/sheet2.xml"), ("s", "styles", "styles.xml")),
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;y&quot;"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="2"><c r="AB2"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>wide</t></is></c></row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2" s="3"><v>7</v></c><c r="D2"><f>A2+1</f><v>8</v></c></row></sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells><hyperlinks><hyperlink ref="D2" r:id="l"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet2.xml.rels": rels(("l", "hyperlink", "http://q/")),
    })
    got = office.xlsx_elements(book)
    assert [r[3] for r in got if r[1] == "sheet"] == ["Second file", "First file"]
    cells = {json.loads(r[4])["cell"]: (r[3], json.loads(r[4])) for r in got if r[1] in ("table_cell", "table_header")}
    assert [cells[c][0] for c in ("A1", "A2", "B2", "C2", "D2", "AB2")] == ["wide", "2024-01-01", "2024-01-01 12:00:00", "7", "8", "1"]
    assert cells["A1"][1]["colspan"] == 3 and cells["D2"][1]["formula"] == "A2+1" and cells["D2"][1]["links"] == ["http://q/"] and (cells["AB2"][1]["row"], cells["AB2"][1]["col"]) == (2, 28)
    assert [(r[1], r[3]) for r in got if r[1].startswith("merged")] == [("merged_cells", None), ("merged_cell", "A1:C1")]


TABLE = """<table><tr><th rowspan=2>Name</th><th colspan=2>Sales</th></tr><tr><th>Q1</th><th>Q2</th></tr>
<tr><th>Ann</th><td>1</td><td rowspan=2>2</td></tr><tr><th>Bob</th><td>3</td></tr><tr><th>Sum</th><td colspan=2>6</td></tr></table>"""


def test_headers_of_cells_under_spans(spark):
    got = [(r[3], json.loads(r[4])) for r in markup.html_elements(TABLE) if r[1] in ("table_cell", "table_header")]
    assert [(t, m["row"], m["col"]) for t, m in got] == [("Name", 0, 0), ("Sales", 0, 1), ("Q1", 1, 1), ("Q2", 1, 2), ("Ann", 2, 0), ("1", 2, 1), ("2", 2, 2), ("Bob", 3, 0), ("3", 3, 1), ("Sum", 4, 0), ("6", 4, 1)]
    df = spark.createDataFrame([("d", TABLE), ("e", TABLE), ("n", None)], "doc_id string, content string")
    el = explode.with_ids(markup.explode_markup(df, "html"), whole=True).cache()
    name = {r.element_id: r.content for r in el.where("doc_id = 'd'").collect()}
    found = {}
    for r in geometry.header_of_cell(el).where("doc_id = 'd'").collect():
        found.setdefault(name[r.element_id], set()).add(name[r.header_id])
    assert found == {"1": {"Sales", "Q1", "Ann"}, "2": {"Sales", "Q2", "Ann", "Bob"}, "3": {"Sales", "Q1", "Bob"}, "6": {"Sales", "Q1", "Q2", "Sum"}}
    assert geometry.header_of_cell(el.limit(0)).count() == 0
