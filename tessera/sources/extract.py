"""Extraction of pages, tables and properties from files, as columns where Spark has the functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types that may come in (fixed values)
ALLOWED = (
    "text/plain", "text/markdown", "text/html", "text/csv", "application/json", "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
LARGEST = 100 * 1024 * 1024


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content, length, modificationTime) of stored files, from any store that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def sniffed(content: Column) -> Column:
    """The type by the first bytes: PDF, Office (zip), HTML, JSON, else plain text."""
    head = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return (
        F.when(head.startswith("%pdf"), "application/pdf")
        .when(head.startswith("pk\x03\x04"), "application/zip")
        .when(head.rlike(r"^\s*<(!doctype html|html)"), "text/html")
        .when(head.rlike(r"^\s*[\[{]"), "application/json")
        .otherwise("text/plain")
    )


def file_errors(length: Column, mime: Column, header: Column, most: int = LARGEST) -> Column:
    """What keeps a file out: empty, too large, a type that is not allowed, fewer than four bytes of header."""
    return F.array_compact(
        F.array(
            F.when(length == 0, F.lit("empty")),
            F.when(length > most, F.lit("too large")),
            F.when(~mime.isin(*ALLOWED), F.lit("unsupported")),
            F.when((length > 0) & (F.length(header) < 4), F.lit("short header")),
        )
    )


def text_pages(text: Column, lines: int = 50) -> Column:
    """Pages (number, title, text) of so many lines each."""
    split = F.split(text, "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(split) - 1) / lines).cast("int"))
    return F.transform(
        starts,
        lambda i: F.struct(
            (i + 1).alias("page_number"),
            F.concat(F.lit("Lines "), (i * lines + 1).cast("string"), F.lit("-"), F.least((i + 1) * lines, F.size(split)).cast("string")).alias("title"),
            F.array_join(F.slice(split, i * lines + 1, F.lit(lines)), "\n").alias("text"),
        ),
    )


def text_counts(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.struct(F.length(text).alias("n_chars"), F.size(F.split(text, "\n", -1)).alias("n_lines"), words.alias("n_words"))


def markdown_counts(text: Column) -> Column:
    """Headings, fences, list items, table lines, paragraphs, and the first heading as title."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return F.struct(
        count(r"(?m)^#{1,6}\s+\S").alias("n_headings"),
        F.floor(count(r"(?m)^```") / 2).cast("int").alias("n_code_blocks"),
        count(r"(?m)^\s*[-*+]\s+\S").alias("n_list_items"),
        count(r"(?m)^\s*\|.+\|\s*$").alias("n_table_lines"),
        F.size(F.filter(F.split(text, r"\n{2,}"), lambda p: F.trim(p) != "")).alias("n_paragraphs"),
        F.regexp_extract(text, r"(?m)^#{1,6}\s+(\S.*)$", 1).alias("title"),
    )


def html_counts(html: Column) -> Column:
    """Title, and how many headings, paragraphs, links, images and tables there are."""
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    return F.struct(
        F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        count(r"(?i)<h[1-6][\s>]").alias("n_headings"),
        count(r"(?i)<p[\s>]").alias("n_paragraphs"),
        count(r"(?i)<a[\s>]").alias("n_links"),
        count(r"(?i)<img[\s>]").alias("n_images"),
        count(r"(?i)<table[\s>]").alias("n_tables"),
        count(r"(?i)<meta[\s>]").alias("n_meta"),
    )


def html_sections(html: Column) -> Column:
    """(number, title, text) by headings; scripts, styles and comments are excluded, tags become line ends."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    parts = F.split(bare, r"(?i)<h[1-6][^>]*>", -1)

    def plain(x: Column) -> Column:
        text = F.regexp_replace(x, r"(?s)<[^>]*>", "\n")
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(char))
        return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda y: y != ""), "\n")

    return F.transform(
        parts,
        lambda x, i: F.struct(i.alias("page_number"), F.when(i > 0, plain(F.regexp_extract(x, r"(?is)^(.*?)</h[1-6]>", 1))).alias("title"), plain(F.when(i > 0, F.regexp_replace(x, r"(?is)^.*?</h[1-6]>", "")).otherwise(x)).alias("text")),
    )


def json_properties(text: Column) -> Column:
    """Kind of the root, number of elements, keys, whether anything is nested; null kind and an error if it is no JSON."""
    value = F.try_parse_json(text)
    kind = F.regexp_extract(F.trim(text), r"^([\[{])", 1)
    keys = F.json_object_keys(F.when(value.isNotNull() & (kind == "{"), text))
    return F.struct(
        F.when(value.isNull(), F.lit(None).cast("string")).when(kind == "{", "object").when(kind == "[", "array").otherwise("scalar").alias("root_type"),
        F.when(kind == "[", F.json_array_length(F.when(value.isNotNull(), text))).otherwise(F.size(keys)).alias("element_count"),
        F.array_join(F.array_sort(F.slice(keys, 1, 50)), ",").alias("top_level_keys"),
        F.coalesce(F.regexp_count(text, F.lit(r"[\[{]")) > 1, F.lit(False)).alias("has_nested"),
        F.when(value.isNull() & text.isNotNull(), "invalid").alias("error"),
    )


def csv_table(text: Column, preview: int = 20) -> Column:
    """Header, number of rows with it, and the first rows as arrays; fields in quotes may hold commas, quotes and line ends.

    Every second part between quotes is inside of them; in the others commas
    and line ends become separators that no text has.
    """
    outside = lambda x: F.translate(x, ",\n\r", "\x1f\x1e")
    parts = F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x))
    lines = F.filter(F.split(F.array_join(parts, '"'), "\x1e"), lambda x: x != "")

    def fields(line: Column) -> Column:
        return F.transform(F.split(line, "\x1f", -1), lambda f: F.replace(F.regexp_replace(f, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))

    return F.struct(fields(F.get(lines, F.lit(0))).alias("header"), F.size(lines).alias("row_count"), F.transform(F.slice(lines, 2, preview), fields).alias("rows"))


def rows_to_csv(rows: Column) -> Column:
    """CSV text of an array of rows, with CRLF; fields with commas, quotes or line ends are quoted."""

    def field(x: Column) -> Column:
        return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return F.concat(F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, field), ",")), "\r\n"), F.lit("\r\n"))


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def rows_to_html(rows: Column) -> Column:
    """An HTML table whose first row is the header."""

    def row(r: Column, i: Column) -> Column:
        cell = F.when(i == 0, "th").otherwise("td")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit("<"), cell, F.lit(">"), escaped(x), F.lit("</"), cell, F.lit(">"))), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def pdf_section_title(first_line: Column) -> Column:
    """A page's first line is its title if it is short, begins like a heading and is no sentence."""
    return F.when((F.length(first_line) < 100) & ~first_line.endswith(".") & first_line.rlike("^[A-Z][a-z]"), first_line)


def needs_ocr(text_pages_: Column, pages: Column) -> Column:
    return (pages > 0) & (text_pages_ / pages < 0.2)


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDD... as a date."""
    return F.try_to_date(F.regexp_extract(value, r"^D:(\d{8})", 1), "yyyyMMdd")
