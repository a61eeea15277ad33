"""Pages, tables, images and properties of Word, PowerPoint and Excel files, which are ZIP files of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part of a file that is larger than this once unpacked is an error of the file.
LARGEST_PART = 256 * 1024 * 1024
#: A sheet's used range, cells without a value among them, has at most so many; one with more is an error of its file.
MOST_CELLS = 5_000_000
# Namespaces and types of the file formats (fixed values)
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
PROPERTIES = {
    "{http://purl.org/dc/elements/1.1/}title": "title",
    "{http://purl.org/dc/elements/1.1/}creator": "author",
    "{http://purl.org/dc/terms/}created": "created",
    "{http://purl.org/dc/terms/}modified": "modified",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}lastModifiedBy": "last_modified_by",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}category": "category",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}keywords": "keywords",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}revision": "revision",
}
PREVIEW_ROWS = 50
COLUMN = re.compile(r"[A-Z]+")

Row = dict


class Package:
    """The parts of one file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > LARGEST_PART:
            raise ValueError(f"{name} is too large")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        data = self.read(name)
        # entities can blow a small part up; these formats have none
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError(f"{name} declares entities")
        return ElementTree.fromstring(data)

    def targets(self, name: str) -> list[tuple[str, str, str]]:
        """(id, type, part) of what a part refers to, in order."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        found = [] if root is None else [r for r in root.iter(f"{PACKAGE}Relationship") if r.get("TargetMode") != "External"]
        part = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return [(r.get("Id"), r.get("Type", "").rpartition("/")[2], part(r.get("Target", ""))) for r in found]

    def properties(self, count: str, n: int) -> Row:
        root = self.xml("docProps/core.xml")
        held = {} if root is None else {PROPERTIES[e.tag]: (e.text or "").strip() for e in root if e.tag in PROPERTIES}
        return {"part": "properties", "properties": {**{name: "" for name in PROPERTIES.values()}, **held, count: str(n)}}

    def images(self, name: str, page: int | None) -> list[Row]:
        found = [part for _, kind, part in self.targets(name) if kind == "image" and part in self.names]
        return [{"part": "image", "number": i, "page_number": page, "title": posixpath.splitext(p)[1].lstrip(".").lower() or "png", "content": self.read(p)} for i, p in enumerate(found, 1)]


def _cells(table: list[list[str]], page: int | None, number: int, title: str | None) -> Row:
    return {"part": "table", "number": number, "page_number": page, "title": title, "header": table[0] if table else [], "rows": table[1:]}


def _page(number: int, title: str | None, text: str) -> Row:
    return {"part": "page", "number": number, "page_number": number, "title": title, "text": text}


def _word_text(element: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else "" for e in element.iter())


def docx(content: bytes) -> list[Row]:
    """A page for each heading and what follows it; tables; images; properties."""
    package = Package(content)
    body = package.xml("word/document.xml").find(f"{W}body")
    styles = package.xml("word/styles.xml")
    names = {} if styles is None else {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in styles.iter(f"{W}style")}
    out, held, section, paragraphs = [], [], None, body.findall(f"{W}p")

    def close() -> None:
        if held:
            out.append(_page(len(out) + 1, section, "\n".join(held)))
            held.clear()

    for p in paragraphs:
        text = _word_text(p).strip()
        if not text:
            continue
        style = p.find(f"{W}pPr/{W}pStyle")
        style = "" if style is None else style.get(f"{W}val", "")
        if "heading" in (names.get(style) or style).lower():
            close()
            section = text
        held.append(text)
    close()
    for i, table in enumerate(body.findall(f"{W}tbl")):
        cells = [["\n".join(_word_text(p) for p in c.findall(f"{W}p")).strip() for c in r.findall(f"{W}tc")] for r in table.findall(f"{W}tr")]
        out.append(_cells(cells, None, i, None))
    return [*out, *package.images("word/document.xml", None), package.properties("page_count", len(paragraphs))]


def _shape_text(body: ElementTree.Element) -> str:
    line = lambda p: "".join(e.text or "" if e.tag == f"{A}t" else "\n" if e.tag == f"{A}br" else "" for e in p.iter())
    return "\n".join(line(p) for p in body.findall(f"{A}p")).strip()


def pptx(content: bytes) -> list[Row]:
    """A page for each slide with text, its first text as title; tables; images; properties."""
    package = Package(content)
    slides = {key: part for key, kind, part in package.targets("ppt/presentation.xml") if kind == "slide"}
    order = [slides[s.get(f"{REL}id")] for s in package.xml("ppt/presentation.xml").iter(f"{P}sldId") if s.get(f"{REL}id") in slides]
    out = []
    for number, name in enumerate(order, 1):
        tree = package.xml(name).find(f"{P}cSld/{P}spTree")
        texts, tables = [], 0
        for shape in tree:
            if shape.tag == f"{P}sp" and shape.find(f"{P}txBody") is not None:
                texts += [t for t in (_shape_text(shape.find(f"{P}txBody")),) if t]
            elif shape.tag == f"{P}graphicFrame":
                for table in shape.iter(f"{A}tbl"):
                    cells = [[_shape_text(c.find(f"{A}txBody")) if c.find(f"{A}txBody") is not None else "" for c in r.findall(f"{A}tc")] for r in table.findall(f"{A}tr")]
                    out.append(_cells(cells, number, tables, f"Slide {number} table {tables + 1}"))
                    tables += 1
        if texts:
            out.append(_page(number, texts[0], "\n".join(texts)))
        out += package.images(name, number)
    return [*out, package.properties("slide_count", len(order))]


def _column(cell: str) -> int:
    n = 0
    for c in COLUMN.match(cell)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _rows_of(sheet: ElementTree.Element, shared: list[str]) -> list[list[str]]:
    found: dict[int, dict[int, str]] = {}
    for i, row in enumerate(sheet.iter(f"{S}row")):
        own = found.setdefault(int(row.get("r", i + 1)) - 1, {})
        for k, cell in enumerate(row.findall(f"{S}c")):
            value, kind = cell.find(f"{S}v"), cell.get("t")
            text = "" if value is None else value.text or ""
            if kind == "s":
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{S}t"))
            elif kind == "b":
                text = "True" if text == "1" else "False"
            own[_column(cell.get("r")) if cell.get("r") else k] = text
    wide = max((c for row in found.values() for c in row), default=-1) + 1
    if wide * (max(found, default=-1) + 1) > MOST_CELLS:
        # one cell in a far corner spans a table that no task could hold
        raise ValueError(f"the used range of a sheet has more than {MOST_CELLS} cells")
    return [[found.get(r, {}).get(c, "") for c in range(wide)] for r in range(max(found, default=-1) + 1)] if wide else []


def xlsx(content: bytes) -> list[Row]:
    """A page and a table for each sheet with cells: its first row is the header, the page shows the first rows; properties."""
    package = Package(content)
    strings = package.xml("xl/sharedStrings.xml")
    shared = [] if strings is None else ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in strings.findall(f"{S}si")]
    parts = {key: part for key, kind, part in package.targets("xl/workbook.xml") if kind == "worksheet"}
    sheets = [(s.get("name", ""), parts[s.get(f"{REL}id")]) for s in package.xml("xl/workbook.xml").iter(f"{S}sheet") if s.get(f"{REL}id") in parts]
    out: list[Row] = []
    number = 0
    for name, part in sheets:
        rows = _rows_of(package.xml(part), shared)
        if not rows:
            continue
        number += 1
        shown = "\n".join(" | ".join(r) for r in rows[1 : 1 + PREVIEW_ROWS])
        out.append(_page(number, name, f"=== Sheet: {name} ===\n{' | '.join(rows[0])}\n{shown}"))
        out.append(_cells(rows, number, number - 1, f"Sheet: {name}"))
    return [*out, package.properties("sheet_count", len(sheets))]


#: Extractors by the ending of a file's name and by its type.
EXTRACTORS = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
SCHEMA = (
    "path string, part string, number int, page_number int, title string, text string, header array<string>, rows array<array<string>>, "
    "content binary, properties map<string,string>, error string"
)
ARROW = pa.schema(
    [
        ("path", pa.string()), ("part", pa.string()), ("number", pa.int32()), ("page_number", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("header", pa.list_(pa.string())),
        ("rows", pa.list_(pa.list_(pa.string()))), ("content", pa.binary()), ("properties", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
    ]
)


def office_parts(files: DataFrame) -> DataFrame:
    """All pages, tables, images and properties (by `part`) of files (path, content), whose format is told by their ending.

    A file that cannot be read is one row with an error; files of other endings
    give none. Files are read one at a time, each in the task that holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                extractor = EXTRACTORS[path.lower().rpartition(".")[2]]
                try:
                    rows = extractor(content.as_py() or b"")
                except Exception as e:  # what is wrong with one file is kept with it
                    rows = [{"part": "error", "error": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist([{**r, "path": path} for r in rows], ARROW)

    ending = F.lower(F.substring_index("path", ".", -1))
    return files.filter(ending.isin(*EXTRACTORS)).select("path", "content").mapInArrow(run, SCHEMA)
