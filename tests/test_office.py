"""Office files that are made here, part by part, and read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import extract, office

RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The &amp; title</dc:title><dc:creator>A. Writer</dc:creator><cp:revision>3</cp:revision></cp:coreProperties>'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def word(body, **more):
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>', "docProps/core.xml": CORE, **more})


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def para(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def cells(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_word():
    styles = '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="u1"><w:name w:val="heading 1"/></w:style></w:styles>'
    rels = RELS.format(f'<Relationship Id="r1" Type="{KIND}/image" Target="media/a.PNG"/><Relationship Id="r2" Type="{KIND}/hyperlink" Target="https://x.example" TargetMode="External"/>')
    body = para("before") + para(" ") + para("One &lt;1&gt;", "u1") + para("text a") + para("text b") + cells(["h1", "h2"], ["a", " b "]) + para("Two", "Heading2") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>"
    got = office.docx(word(body, **{"word/styles.xml": styles, "word/_rels/document.xml.rels": rels, "word/media/a.PNG": b"img"}))
    assert [(r["page_number"], r["title"], r["text"]) for r in got if r["part"] == "page"] == [(1, None, "before"), (2, "One <1>", "One <1>\ntext a\ntext b"), (3, "Two", "Two\nx\ty\nz")]
    assert [(r["header"], r["rows"]) for r in got if r["part"] == "table"] == [(["h1", "h2"], [["a", "b"]])]
    assert [(r["title"], r["content"]) for r in got if r["part"] == "image"] == [("png", b"img")]
    assert got[-1]["properties"] | {} == {**got[-1]["properties"], "title": "The & title", "author": "A. Writer", "revision": "3", "page_count": "7", "category": ""}


def test_slides():
    head = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda *lines: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda *shapes: f"<p:sld {head}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation {head}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format("".join(f'<Relationship Id="r{i}" Type="{KIND}/slide" Target="slides/slide{i}.xml"/>' for i in (1, 2, 3))),
        "ppt/slides/slide1.xml": slide(shape("later"), table),
        "ppt/slides/slide2.xml": slide(shape(" "), shape("Title"), shape("a", "b")),
        "ppt/slides/slide3.xml": slide(),
        "ppt/slides/_rels/slide1.xml.rels": RELS.format(f'<Relationship Id="r1" Type="{KIND}/image" Target="../media/i.jpeg"/>'),
        "ppt/media/i.jpeg": b"jpg",
    }
    got = office.pptx(zipped(parts))
    assert [(r["page_number"], r["title"], r["text"]) for r in got if r["part"] == "page"] == [(1, "Title", "Title\na\nb"), (2, "later", "later")]
    assert [(r["page_number"], r["title"], r["header"], r["rows"]) for r in got if r["part"] == "table"] == [(2, "Slide 2 table 1", ["h"], [["v"]])]
    assert [(r["page_number"], r["content"]) for r in got if r["part"] == "image"] == [(2, b"jpg")] and got[-1]["properties"]["slide_count"] == "3"


def sheet_file(*sheets):
    head = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
    parts = {
        "xl/workbook.xml": f"<workbook {head}><sheets>{names}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": RELS.format("".join(f'<Relationship Id="r{i}" Type="{KIND}/worksheet" Target="/xl/worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))),
        "xl/sharedStrings.xml": f"<sst {head}><si><t>shared</t></si><si><r><t>in </t></r><r><t>runs</t></r></si></sst>",
    }
    return zipped(parts | {f"xl/worksheets/sheet{i}.xml": f"<worksheet {head}><sheetData>{data}</sheetData></worksheet>" for i, (_, data) in enumerate(sheets)})


def test_sheets():
    data = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>2.5</v></c><c r="C3" t="inlineStr"><is><t>in line</t></is></c><c r="AA3" t="b"><v>1</v></c></row>'
    got = office.xlsx(sheet_file(("First", data), ("Empty", ""), ("Last", '<row><c><v>7</v></c></row>')))
    pages = [r for r in got if r["part"] == "page"]
    assert [(r["page_number"], r["title"]) for r in pages] == [(1, "First"), (2, "Last")] and pages[1]["text"] == "=== Sheet: Last ===\n7\n"
    table = next(r for r in got if r["part"] == "table")
    assert table["header"][:3] == ["shared", "", "in runs"] and len(table["header"]) == 27 and table["rows"][0] == [""] * 27 and table["rows"][1][1:3] == ["2.5", "in line"] and table["rows"][1][26] == "True"
    assert got[-1]["properties"]["sheet_count"] == "3"


def test_files_on_spark(spark, tmp_path):
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa">]><w:document/>'
    for name, data in {"a.docx": word(para("hello")), "b.XLSX": sheet_file(("S", '<row><c><v>1</v></c></row>')), "c.docx": b"not a zip", "d.docx": zipped({"word/document.xml": bomb}), "e.txt": b"text", "f.pptx": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = office.office_parts(extract.files(spark, str(tmp_path)))
    name = F.substring_index("path", "/", -1)
    rows = {(r["n"], r["part"]): r["text"] or r["error"] for r in got.select(name.alias("n"), "part", "text", "error").collect()}
    assert rows["a.docx", "page"] == "hello" and "b.XLSX" in {k for k, _ in rows} and rows["c.docx", "error"].startswith("BadZipFile") and "entities" in rows["d.docx", "error"]
    assert rows["f.pptx", "error"] and not any(k == "e.txt" for k, _ in rows)


def test_a_cell_in_a_far_corner():
    import pytest

    far = sheet_file(("S", '<row r="1"><c r="A1"><v>1</v></c></row><row r="1048576"><c r="XFD1048576"><v>2</v></c></row>'))
    with pytest.raises(ValueError, match="used range"):
        office.xlsx(far)
    near = office.xlsx(sheet_file(("S", '<row r="900"><c r="ZZ900"><v>1</v></c></row>')))
    assert next(r for r in near if r["part"] == "table")["rows"][-1][-1] == "1"
