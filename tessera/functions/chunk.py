"""Chunkers: a text becomes an array of chunks.

Each is one walk over a text's sentences, lines or paragraphs, in time in
proportion to the text, which Arrow brings to Python whole; what a chunk is
made into afterwards (checksums, sizes, filters) are expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import SENTENCE_END, code_language, hash16, looks_like_code, quarter_tokens

CHUNK = "struct<content:string,chunk_type:string,section_title:string,section_hierarchy:array<string>>"
FAMILY = CHUNK.replace(">>", ">,parent:string>")

#: White space is that of ASCII, as in the expressions.
SPACE = " \t\n\x0b\f\r"
SENTENCE = re.compile(SENTENCE_END, re.ASCII)
BLANK = re.compile("\n{2,}")
HEADING = re.compile(r"(#{1,6})\s+(.+)", re.ASCII)
RULE = re.compile("[=-]{3,}")
FENCE = re.compile("`{3,}|~{3,}")
TABLE_LINE = re.compile(r"\s*\|.+\|\s*", re.ASCII)
# Lines of dense content: code, tables, lists, fences (fixed values)
DENSE = r"^\s{4,}\S|^\|.+\|$|^\d+[.\)]\s+\S|^[-*]\s+\S|^```"
# Where a top-level unit of code begins (fixed values)
UNITS = {
    "python": re.compile(r"^(async\s+def|def|class)\s+\w+", re.MULTILINE),
    "javascript": re.compile(r"^(export\s+)?(async\s+)?function\s+\w+|^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(|^class\s+\w+", re.MULTILINE),
    "typescript": re.compile(
        r"^(export\s+)?(async\s+)?function\s+\w+|^(export\s+)?(const|let|var)\s+\w+|^(export\s+)?(abstract\s+)?class\s+\w+|^(export\s+)?interface\s+\w+|^(export\s+)?type\s+\w+\s*=",
        re.MULTILINE,
    ),
    "sql": re.compile(r"^(CREATE|ALTER|DROP|INSERT|SELECT|UPDATE|DELETE|WITH)\b", re.MULTILINE | re.IGNORECASE),
    "java": re.compile(r"^(public|private|protected|static)?\s*(class|interface|enum|void|[A-Z]\w+)\s+\w+", re.MULTILINE),
    "go": re.compile(r"^func\s+(\(\w+\s+\*?\w+\)\s+)?\w+\s*\(", re.MULTILINE),
    "rust": re.compile(r"^(pub\s+)?(async\s+)?fn\s+\w+|^(pub\s+)?(struct|enum|trait|impl)\s+\w+", re.MULTILINE),
}
_DENSE = re.compile(DENSE, re.ASCII)


def _pieces(parts: Iterable[str]) -> list[str]:
    """The parts without white space around them, blank ones left out."""
    return [p for p in (x.strip(SPACE) for x in parts) if p]


def _packed(parts: list[str], limit: Callable[[str], int], joined: str, overlap: int = 0, least: int = 0) -> Iterator[str]:
    """Parts in order while their lengths stay within the limit, which may depend on the part that comes next.

    The last parts that fit together into the overlap begin the next chunk.
    """
    now: list[str] = []
    size = 0
    for part in parts:
        if now and size + len(part) > limit(part):
            yield joined.join(now)
            first, size = len(now), 0
            while overlap and first and size + len(now[first - 1]) <= overlap:
                first -= 1
                size += len(now[first])
            now = now[first:]
        now.append(part)
        size += len(part)
    if now and size >= least:
        yield joined.join(now)


def _by_sentences(text: str, size: int, least: int, overlap: int) -> Iterator[str]:
    return _packed(_pieces(SENTENCE.split(text)), lambda _: size, " ", overlap, least)


def _by_paragraphs(text: str, size: int) -> Iterator[str]:
    return _packed(_pieces(BLANK.split(text)), lambda _: size, "\n\n")


def _sections(text: str) -> Iterator[tuple[int | None, str | None, str]]:
    """(level, heading, body) by headings with # and by underlined ones; what comes first has neither."""
    level, heading, body = None, None, []
    for line in text.split("\n"):
        marked = HEADING.fullmatch(line)
        if not marked and not (body and RULE.fullmatch(line)):
            body.append(line)
            continue
        above = None if marked else body.pop()
        if body or heading:
            yield level, heading, "\n".join(body)
        level, heading, body = (len(marked[1]), marked[2].strip(SPACE), []) if marked else (1 if line[0] == "=" else 2, above.strip(SPACE), [])
    if body or heading:
        yield level, heading, "\n".join(body)


Found = tuple[str, str, str | None, list[str]]


def _headings(text: str, size: int, least: int, overlap: int) -> Iterator[Found]:
    above: list[str] = []
    for level, heading, body in _sections(text):
        bare = body.strip(SPACE)
        if not bare:
            continue
        if level is not None:
            above = [*above[: level - 1], heading or ""]
        for part in _by_sentences(body, size, least, overlap) if len(body) > size else (bare,):
            yield part, "section", heading, above


def _markdown(text: str, least: int) -> Iterator[Found]:
    now: list[str] = []
    size, title, code = 0, None, False
    for line in text.split("\n"):
        code ^= FENCE.match(line) is not None
        heading = None if code else HEADING.fullmatch(line)
        if heading and now and size >= least:
            yield "\n".join(now), "markdown_section", title, []
            now, size = [], 0
        now.append(line)
        size += len(line) + 1
        title = heading[2].strip(SPACE) if heading else title
    yield "\n".join(now), "markdown_section", title, []


def _tables(text: str, least: int) -> Iterator[Found]:
    run: list[str] = []
    in_table = False
    for line in [*text.split("\n"), None]:
        is_table = line is not None and TABLE_LINE.fullmatch(line) is not None
        if run and (line is None or is_table != in_table):
            content = "\n".join(run).strip(SPACE)
            if content and (in_table or len(content) >= least):
                yield content, "table" if in_table else "text", None, []
            run = []
        run.append(line)
        in_table = is_table


def _adaptive(text: str, size: int) -> Iterator[str]:
    def limit(paragraph: str) -> int:
        lines = paragraph.split("\n")
        return int(size * max(0.3, 1.0 - sum(_DENSE.search(x) is not None for x in lines) / len(lines) * 0.7))

    return _packed(_pieces(BLANK.split(text)), limit, "\n\n")


def _ocr(text: str, size: int, least: int, overlap: int) -> Iterator[str]:
    paragraphs: list[str] = []
    held: list[str] = []
    for raw in [*text.split("\n"), ""]:
        raw = raw.strip(SPACE)
        if held and (not raw or held[-1][-1] in ".!?"):
            paragraphs.append(" ".join(held))
            held = []
        if raw:
            held.append(raw)
    return _by_sentences("\n\n".join(paragraphs), size, least, overlap)


def _code(text: str, language: str, size: int) -> Iterator[str]:
    starts = [m.start() for m in UNITS[language].finditer(text)] if language in UNITS else []
    if not starts:
        yield from _by_paragraphs(text, size)
        return
    bounds = [0, *starts, len(text)]
    for unit in _pieces(text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)):
        yield from _by_paragraphs(unit, size) if len(unit) > size else (unit,)


def _families(text: str, parent: int, child: int, overlap: int) -> Iterator[tuple]:
    for content, kind, title, above in _headings(text, parent, 100, 100):
        yield content, kind, title, above, None
        name = hashlib.sha256(content.encode()).hexdigest()[:16]
        for part in _by_sentences(content, child, 100, overlap):
            yield part, "child", title, above, name


#: About so many bytes of texts are Python objects at a time.
PART = 1_000_000
_ITEM = [("content", pa.string()), ("chunk_type", pa.string()), ("section_title", pa.string()), ("section_hierarchy", pa.list_(pa.string()))]


def _udf(chunker: Callable[..., Iterable], *columns: Column, family: bool = False) -> Column:
    """The chunker as a column; null texts have no chunks."""
    fields = [pa.field(*f) for f in ([*_ITEM, ("parent", pa.string())] if family else _ITEM)]

    def some(*columns: pa.Array) -> pa.Array:
        values, ends = [[] for _ in fields], [0]
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            for found in chunker(*row) if row[0] is not None else ():
                for held, value in zip(values, found, strict=True):
                    held.append(value)
            ends.append(len(values[0]))
        items = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    def run(*columns: pa.Array) -> pa.Array:
        # some texts at a time are Python objects, so that memory is that of the batch and of these
        sizes = pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // PART
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()]
        out = [some(*(c.slice(a, b - a) for c in columns)) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
        return out[0] if len(out) == 1 else pa.concat_arrays(out)

    # Spark tells an Arrow function by its signature
    if len(columns) == 1:

        def one(text: pa.Array) -> pa.Array:
            return run(text)

        return F.arrow_udf(one, f"array<{FAMILY if family else CHUNK}>")(*columns)

    def two(text: pa.Array, more: pa.Array) -> pa.Array:
        return run(text, more)

    return F.arrow_udf(two, f"array<{FAMILY if family else CHUNK}>")(*columns)


def _typed(chunker: Callable[..., Iterable[str]], kind: str) -> Callable[..., Iterator[Found]]:
    return lambda *row: ((c, kind, None, []) for c in chunker(*row))


def semantic(text: Column, size: int = 1024, least: int = 100, overlap: int = 100) -> Column:
    """Sentences up to the size; each chunk begins with the last sentences of the one before that fit the overlap."""
    return _udf(_typed(lambda t: _by_sentences(t, size, least, overlap), "semantic"), text)


def headings(text: Column, size: int = 1024, least: int = 100, overlap: int = 100) -> Column:
    """Sections with their place in the headings' hierarchy; longer ones by sentences."""
    return _udf(lambda t: _headings(t, size, least, overlap), text)


def markdown(text: Column, least: int = 100) -> Column:
    """Cut at headings outside of fenced code; what is shorter than `least` goes with what follows. No largest size."""
    return _udf(lambda t: _markdown(t, least), text)


def tables(text: Column, least: int = 100) -> Column:
    """Runs of |...| lines are chunks of their own; the text between them if it is long enough."""
    return _udf(lambda t: _tables(t, least), text)


def adaptive(text: Column, size: int = 1024) -> Column:
    """Paragraphs up to a size that shrinks with the share of dense lines, to three tenths at the least."""
    return _udf(_typed(lambda t: _adaptive(t, size), "adaptive"), text)


def ocr(text: Column, size: int = 1024, least: int = 100, overlap: int = 100) -> Column:
    """Lines are joined unless the one before ends a sentence or is blank; then by sentences."""
    return _udf(_typed(lambda t: _ocr(t, size, least, overlap), "ocr_text"), text)


def code(text: Column, size: int = 1024) -> Column:
    """Units of the language that the text shows; longer ones, and unknown languages, by blank lines."""
    return _udf(_typed(lambda t, language: _code(t, language, size), "code"), text, code_language(text))


def parent_child(text: Column, parent: int = 2048, child: int = 512, overlap: int = 64) -> Column:
    """Sections, each followed by its children by sentences; a child names its parent by the first 16 hex digits of its SHA-256."""
    return _udf(lambda t: _families(t, parent, child, overlap), text, family=True)


def words(text: Column, size: int = 1024) -> Column:
    """For texts without sentences or paragraphs: sentences if there are several, else runs of a fifth as many words as the size has characters."""

    def cut(t: str) -> Iterator[str]:
        if len(_pieces(SENTENCE.split(t))) > 1:
            yield from _by_sentences(t, size, 0, 0)
            return
        found, step = t.split(), max(1, size // 5)
        yield from (" ".join(found[i : i + step]) for i in range(0, len(found), step))

    return _udf(_typed(cut, "words"), text)


STRATEGIES = {"semantic": semantic, "heading": headings, "markdown": markdown, "table_aware": tables, "code": code, "ocr": ocr, "adaptive": adaptive}
# The strategy of each type of file (fixed values)
BY_MIME = {
    "text/markdown": "markdown",
    "text/csv": "table_aware",
    "text/html": "heading",
    "text/x-python": "code",
    "text/javascript": "code",
    "text/typescript": "code",
    "application/json": "semantic",
    "application/pdf": "adaptive",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "heading",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "heading",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "table_aware",
}


def strategy(mime: Column, text: Column) -> Column:
    """By the file's type; of unknown types code by its looks, else adaptive."""
    known = F.create_map(*(F.lit(x) for pair in BY_MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(mime, F.lit(""))), F.when(looks_like_code(text), "code"), F.lit("adaptive"))


def chunk_documents(docs: DataFrame, name: str = "auto", least: int = 100, text: str = "text", mime: str | None = None) -> DataFrame:
    """One row a chunk: the documents' other columns, chunk_index, content, type, title, hierarchy, sizes, checksum.

    Blank chunks and those shorter than `least` go, unless all would. With
    "auto" each document has the strategy of its type.
    """
    if name == "auto":
        # one pass: each document takes the branch of its strategy
        by = {"semantic": _typed(lambda t: _by_sentences(t, 1024, 100, 100), "semantic"), "heading": lambda t: _headings(t, 1024, 100, 100), "markdown": lambda t: _markdown(t, 100)}
        by |= {"table_aware": lambda t: _tables(t, 100), "ocr": _typed(lambda t: _ocr(t, 1024, 100, 100), "ocr_text"), "adaptive": _typed(lambda t: _adaptive(t, 1024), "adaptive")}
        in_code = _typed(lambda t, language: _code(t, language, 1024), "code")
        picked = strategy(F.col(mime) if mime else F.lit(None).cast("string"), F.col(text))
        # code needs its language, too
        named = F.when(picked == "code", F.concat(F.lit("code:"), code_language(F.col(text)))).otherwise(picked)
        found = _udf(lambda t, name: in_code(t, name[5:]) if name.startswith("code:") else by[name](t), F.col(text), named)
    else:
        found = STRATEGIES[name](F.col(text))
    rest = [c for c in docs.columns if c != text]
    held = docs.select(*rest, found.alias("_found")).select(*rest, F.filter("_found", lambda c: F.regexp_replace(c["content"], r"\A\s++|(?<!\s)\s++\z", "") != "").alias("_all"))
    held = held.withColumn("_long", F.filter("_all", lambda c: F.length(c["content"]) >= least))
    exploded = held.select(*rest, F.posexplode(F.when(F.size("_long") > 0, F.col("_long")).otherwise(F.col("_all"))).alias("chunk_index", "c")).select(*rest, "chunk_index", "c.*")
    return exploded.withColumns(
        {"content_checksum": hash16(F.col("content")), "char_count": F.length("content"), "token_count": quarter_tokens(F.col("content"))}
    )
