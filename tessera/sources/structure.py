"""Sections and tables of Markdown and HTML as rows: lines or tags in order, running sums for what they are in, groups by these.

Everything is a window over one document's lines or tags and a group by the
running numbers; no document is a value of one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import saved

#: A task's pages are of about so many bytes; their tokens take some fifteen times as many.
PART = 4_000_000
# What lines of Markdown are (fixed values)
FENCE, HEADING, TABLE_LINE = r"^\s{0,3}```", r"^(#{1,6})\s+(\S.*)$", r"^\s*\|.+\|\s*$"
SEPARATOR = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"


def _running(what: Column, key: str, order: str) -> Column:
    """How many rows of a document there were so far, with this one, for which it holds."""
    return F.sum(F.when(what, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order))


def markdown_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line, code): the lines of each text from 0, and whether they are in a fence or are its marks."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)).alias("n", "line"))
    fence = F.col("line").rlike(FENCE)
    fences = _running(fence, key, "n")
    return lines.withColumn("code", fence | (fences % 2 == 1))


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, level, title, path, first_line, text): what stands below each heading.

    Section 0 is what stands before the first heading, with level 0 and no
    title; it is left out where it is blank. `path` has the titles of the
    headings that a section is in, its own last: of each smaller level the last
    one that no heading of a still smaller level follows. Headings in fences are
    text. Null texts have no sections; a key must be one document's.
    """
    lines = markdown_lines(docs, key, text)
    marks = ~F.col("code") & F.col("line").rlike(HEADING)
    lines = lines.withColumn("head", marks).withColumn("section", _running(marks, key, "n"))
    found = lines.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), F.length(F.regexp_extract("line", HEADING, 1)))).alias("level"), F.max(F.when(F.col("head"), F.trim(F.regexp_extract("line", HEADING, 2)))).alias("title"),
        F.min("n").alias("first_line"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))).alias("lines"),
    )
    body = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"\A\s++|(?<!\s)\s++\z", "")
    found = found.select(key, "section", F.coalesce("level", F.lit(0)).alias("level"), "title", "first_line", body.alias("text"))
    return nested(found, key).filter("section > 0 OR text <> ''")


def nested(sections: DataFrame, key: str) -> DataFrame:
    """Sections (key, section, level, title, ...) with the path of titles that each is in."""
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sections
    for level in range(1, 7):
        last = F.max(F.when(F.col("level") == level, F.struct("section", "title"))).over(before)
        out = out.withColumn(f"_l{level}", last)
    steps, highest = [], F.lit(-1)
    for level in range(1, 7):
        held = F.col(f"_l{level}")
        # nothing above it came later, and it is not below this section's own level
        steps.append(F.when((held["section"] > highest) & (F.lit(level) <= F.col("level")), held["title"]))
        highest = F.greatest(highest, F.coalesce(held["section"], F.lit(-1)))
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return out.withColumn("path", path).drop(*(f"_l{level}" for level in range(1, 7)))


def _cells(line: Column) -> Column:
    """The cells of a table's line; a bar behind a backslash is no border."""
    inner = F.regexp_replace(line, r"^\s*\||\|\s*$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def markdown_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table_no, row_no, head, cells): tables of bars, from 1; row 0 is the head, the line of dashes below it is none.

    Lines of bars that follow each other are a table if the second is one of
    dashes. Those in fences are text.
    """
    lines = markdown_lines(docs, key, text).filter(~F.col("code") & F.col("line").rlike(TABLE_LINE))
    w = Window.partitionBy(key).orderBy("n")
    # an island: lines that follow each other have the same difference of line and place
    island = F.col("n") - F.row_number().over(w)
    lines = lines.withColumn("island", island).withColumn("at", F.row_number().over(Window.partitionBy(key, "island").orderBy("n")))
    second = F.max(F.when(F.col("at") == 2, F.col("line").rlike(SEPARATOR))).over(Window.partitionBy(key, "island"))
    kept = lines.withColumn("ok", F.coalesce(second, F.lit(False))).filter("ok AND at <> 2")
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("island"))
    return kept.select(key, number.alias("table_no"), F.greatest(F.col("at") - 2, F.lit(0)).alias("row_no"), (F.col("at") == 1).alias("head"), _cells(F.col("line")).alias("cells"))


# Parts of a page whose content is no text (fixed values)
NO_TEXT = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>"
# Character references that are told apart (fixed values)
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def plain(text: Column) -> Column:
    """Character references as characters, white space as one space, none at the ends."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n, token, tag, closing): tags and texts of each page in order; texts have no tag."""
    found = F.regexp_extract_all(F.regexp_replace(html, NO_TEXT, ""), F.lit(r"(?s)<[/!a-zA-Z][^>]*>|<|[^<]+"), 0)
    rows = pages.select(key, F.posexplode(found).alias("n", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    return rows.withColumn("tag", name).withColumn("closing", F.col("token").startswith("</"))


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cell_no, head, text): the cells of each page's tables, numbers from 1.

    A table in a cell of another is text of that cell. A cell is a head if it
    is a th or in a thead. Rows and cells end where the next one begins, as end
    tags may be left out; what stands between cells is in none.
    """
    # pages meet their tasks before they become tokens, in parts that do not grow with the table; all windows have one order, so that tokens are sorted once
    read = saved(pages.select(key, html))
    total = read.agg(F.coalesce(F.sum(F.octet_length(html).cast("long")), F.lit(0))).first()[0]
    parts = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    t = html_tokens(read.repartition(parts, F.col(key)), key, html)
    t = t.withColumn("token", F.when(F.col("tag") == "", F.col("token")))
    of = lambda *tags: F.col("tag").isin(*tags)
    opens, closes = of("table") & ~F.col("closing"), of("table") & F.col("closing")
    w = Window.partitionBy(key).orderBy("n")
    number = lambda what: F.sum(F.when(what, 1).otherwise(0)).over(w)
    t = t.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    outer, top = opens & (F.col("depth") == 1), F.col("depth") == 1
    new_row, begins = top & of("tr") & ~F.col("closing"), top & of("td", "th") & ~F.col("closing")
    t = t.withColumns({"table_no": number(outer), "rows": number(new_row), "cells": number(begins)})
    # numbers within a table or a row are those of the page less what there was before it began
    since = lambda what, value: F.last(F.when(what, value), True).over(w)
    # the last thing in a table that was a part of it, and in a row that opened or closed a cell
    group = F.when(outer, F.lit(False)).when(top & of("thead", "tbody", "tfoot"), of("thead") & ~F.col("closing"))
    ends = top & F.col("tag").isin("td", "th", "tr", "thead", "tbody", "tfoot", "caption") & F.col("closing")
    inside = F.when(begins, F.lit(True)).when(outer | new_row | ends, F.lit(False))
    t = t.withColumns(
        {
            "row_no": F.col("rows") - since(outer, F.col("rows")),
            "cell_no": F.col("cells") - since(outer | new_row, F.col("cells")),
            "thead": F.last(group, True).over(w),
            "inside": F.coalesce(F.last(inside, True).over(w), F.lit(False)),
        }
    )
    t = t.filter((F.col("depth") >= 1) & ~outer)
    cells = t.filter((F.col("row_no") > 0) & (F.col("cell_no") > 0) & (F.col("inside") | begins))
    piece = F.when(F.col("tag") == "", F.struct("n", F.col("token").alias("s"))).when(~begins, F.struct("n", F.lit(" ").alias("s")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "")
    head = F.max(begins & (of("th") | F.coalesce("thead", F.lit(False))))
    return cells.groupBy(key, "table_no", "row_no", "cell_no").agg(head.alias("head"), plain(joined).alias("text"))


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section, level, title, path, text): what stands below each of h1 to h6, as for Markdown; the head of the page is in none."""
    t = html_tokens(pages, key, html)
    w = Window.partitionBy(key).orderBy("n")
    t = t.withColumn("in_head", F.sum(F.when(F.col("tag") == "head", F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)).over(w)).filter("in_head <= 0 AND tag <> 'head'")
    heading = F.col("tag").rlike("^h[1-6]$")
    opens = heading & ~F.col("closing")
    t = t.withColumn("section", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    t = t.withColumn("titled", F.coalesce(F.last(F.when(heading, ~F.col("closing")), True).over(w), F.lit(False)))
    piece = F.struct("n", F.when(F.col("tag") == "", F.col("token")).otherwise(F.lit(" ")).alias("s"))
    joined = lambda where: plain(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, piece))), lambda x: x["s"]), ""))
    found = t.groupBy(key, "section").agg(
        F.coalesce(F.max(F.when(opens, F.substring("tag", 2, 1).cast("int"))), F.lit(0)).alias("level"), joined(F.col("titled")).alias("title"), joined(~F.col("titled")).alias("text")
    )
    found = found.withColumn("title", F.when(F.col("section") > 0, F.col("title")))
    return nested(found, key).filter("section > 0 OR text <> ''")


def html_meta(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, name, content): title, charset and the named values of meta tags; of several of a name the first."""
    t = html_tokens(pages, key, html).filter("tag = 'meta' AND NOT closing")
    value = lambda name: F.coalesce(*(F.nullif(F.regexp_extract("token", rf"(?is)\s{name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")))
    named = t.select(key, "n", F.lower(F.coalesce(value("name"), value("property"), value("http-equiv"), F.when(value("charset").isNotNull(), "charset"))).alias("name"), F.coalesce(value("content"), value("charset")).alias("content"))
    title = pages.select(key, F.lit(-1).alias("n"), F.lit("title").alias("name"), F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), F.lit("")).alias("content"))
    both = named.unionByName(title).filter("name IS NOT NULL AND content IS NOT NULL")
    return both.groupBy(key, "name").agg(F.min_by("content", "n").alias("content")).select(key, "name", plain(F.col("content")).alias("content"))
