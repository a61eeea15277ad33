"""Extraction over whole tables: documents as text files, pages as HTML, events as JSON, parts as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.common import table
from tessera.sources import extract as X
from tessera.sources import structure as T


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.text_pages(F.col("text"), 5)).alias("p"))
    return pages.select("doc_id", "p.page_number", "p.title", F.md5(F.col("p.text").cast("binary")).alias("digest"))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


def markdown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("# Top of "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Part\n- item\n| a | b |\n```\nx\n```\n")))
    return table(spark, sf_dir, "documents").select("doc_id", X.markdown_counts(marked).alias("c")).select("doc_id", "c.*")


def html_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_counts(F.col("html")).alias("c")).select("page_id", "c.*")


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select("page_id", F.explode(X.html_sections(F.col("html"))).alias("s"))
    return parts.select("page_id", "s.page_number", "s.title", F.length("s.text").alias("n_chars"))


def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.json_properties(cut).alias("j")).select("event_id", "j.*")


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts, ten thousand keys at a time, written as CSV and read again; names hold commas, quotes and line ends."""
    rows = F.array_sort(F.collect_list(F.array(F.col("p_partkey").cast("string"), F.concat(F.col("p_name"), F.lit(', "new"\nor\r\nold')), "p_type")))
    held = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000).alias("block")).agg(rows.alias("rows"))
    text = X.rows_to_csv(F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("type"))), "rows"))
    read = held.select("p_brand", "block", "rows", F.md5(text.cast("binary")).alias("csv_digest"), F.md5(X.rows_to_html("rows").cast("binary")).alias("html_digest"), X.csv_table(text, 1 << 20).alias("t"))
    return read.select("p_brand", "block", "csv_digest", "html_digest", F.col("t.row_count").alias("row_count"), F.array_join("t.header", ",").alias("header"), (F.col("t.rows") == F.col("rows")).alias("same"))


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, pages and JSON as files of unknown type."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("text").cast("binary").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").cast("binary").alias("content"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("props").cast("binary").alias("content"))
    rows = docs.unionByName(pages).unionByName(events)
    errors = X.file_errors(F.length("content"), X.sniffed(F.col("content")), F.substring("content", 1, 4), 4000)
    return rows.groupBy("kind", X.sniffed(F.col("content")).alias("mime"), F.array_join(errors, ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content").cast("long")).alias("n_bytes"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as titles, order dates as PDF dates."""
    first = F.regexp_extract("text", r"\A([^\n]*)", 1)
    return table(spark, sf_dir, "documents").select("doc_id", X.pdf_section_title(first).alias("title"), X.needs_ocr(F.lit(1), F.col("n_chars") % 9).alias("needs_ocr"), X.pdf_date(F.concat(F.lit("D:"), (20200101 + F.col("doc_id") % 40).cast("string"), F.lit("120000"))).alias("created"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line ends become headings of three levels, with a heading in a fence before."""
    head = F.concat(F.lit("before\n\n# Top of "), "source", F.lit("\n```\n# no heading\n```\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n## Part\ntext\n#### Deep\n### Less deep\n"))).alias("text"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.markdown_sections(_marked(spark, sf_dir))
    return found.select("doc_id", "section", "level", "title", F.array_join("path", " > ").alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts, ten thousand keys at a time, as two Markdown tables with text between, read again as rows."""
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    name = F.concat("p_name", F.lit(" \\| new"))
    held = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line(F.col("p_partkey").cast("string"), name, "p_type").alias("line")))), lambda r: r["line"]), "\n").alias("lines")
    )
    text = F.concat(F.lit("| no | table |\n\n| key | name | type |\n|---|:-:|--:|\n"), "lines", F.lit("\n\ntext\n```\n| a |\n|---|\n```\n| x |\n|---|\n| y |"))
    rows = T.markdown_tables(held.select(F.concat_ws("/", "p_brand", "block").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", "table_no", "row_no", "head", F.array_join("cells", ";").alias("cells"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts as HTML: a table with a head, one within a cell, end tags that are left out; read again as cells."""
    row = F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td>\n<td class=x>"), "p_name", F.lit(" &amp; <b>new</b>\n<td><table><tr><td>"), "p_type", F.lit("</td></tr></table></td></tr>"))
    held = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda r: r["row"]), "\n").alias("rows")
    )
    page = F.concat(F.lit("<p>text</p><table border=1><thead><tr><th>key<td>name<th>type</thead><tbody>"), "rows", F.lit("</tbody></table><script>'<table><tr><td>'</script><table><tr><th>x</th></tr></table>"))
    return T.html_tables(held.select(F.concat_ws("/", "p_brand", "block").alias("page_id"), page.alias("html")))


def html_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own sections, each paragraph of every page being made a heading of the second level with a text."""
    marked = F.regexp_replace("html", r"<p>", "<h2>Part</h2>text<h3>Sub</h3><p>")
    found = T.html_sections(table(spark, sf_dir, "pages").select("page_id", marked.alias("html")))
    return found.groupBy("page_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("deepest"))


def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.html_meta(table(spark, sf_dir, "pages")).filter("name <> 'title'")
    return found.select("page_id", "name", "content")


QUERIES = {
    "markdown_sections": markdown_sections,
    "markdown_tables": markdown_tables,
    "html_tables": html_tables,
    "html_nested_sections": html_nested,
    "html_meta": html_meta,
    "text_pages": text_pages,
    "text_counts": text_counts,
    "markdown_counts": markdown_counts,
    "html_counts": html_counts,
    "html_sections": html_sections,
    "json_properties": json_properties,
    "csv_tables": csv_tables,
    "file_checks": file_checks,
    "title_heuristics": titles,
}

_NL = "chr(10)"
_BLOCKS = """
p AS (SELECT concat(p_brand, '/', p_partkey // 10000) AS doc_id, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand, p_partkey // 10000 ORDER BY p_partkey) AS r FROM part), b AS (SELECT DISTINCT doc_id FROM p)"""
SQL = {
    "markdown_sections": r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, 0 AS section, 0 AS level, NULL AS title, '' AS path, 'before' AS body FROM d
  UNION ALL SELECT doc_id, 1, 1, concat('Top of ', source), concat('Top of ', source), concat('```', chr(10), '# no heading', chr(10), '```', chr(10), l[1]) FROM d
  UNION ALL SELECT doc_id, 3 * i - 5 + k, [2, 4, 3][k], ['Part', 'Deep', 'Less deep'][k], concat('Top of ', source, ' > Part', ['', ' > Deep', ' > Less deep'][k]), ['text', '', l[i]][k]
    FROM (SELECT doc_id, source, l, unnest(range(2, len(l) + 1)) AS i FROM d), (SELECT unnest([1, 2, 3]) AS k)
)
SELECT doc_id, section::BIGINT AS section, level::INT AS level, title, path, md5(regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '')) AS digest FROM s""",
    "markdown_tables": f"""
WITH {_BLOCKS}, h AS (
  SELECT doc_id, 1 AS table_no, 0 AS row_no, true AS head, 'key;name;type' AS cells FROM b
  UNION ALL SELECT doc_id, 1, r, false, concat(p_partkey, ';', p_name, ' | new;', p_type) FROM p
  UNION ALL SELECT doc_id, 2, 0, true, 'x' FROM b UNION ALL SELECT doc_id, 2, 1, false, 'y' FROM b
) SELECT doc_id, table_no::INT AS table_no, row_no::INT AS row_no, head, cells FROM h""",
    "html_tables": f"""
WITH {_BLOCKS}, h AS (
  SELECT doc_id AS page_id, 1 AS table_no, 1 AS row_no, k AS cell_no, true AS head, ['key', 'name', 'type'][k] AS text FROM b, (SELECT unnest([1, 2, 3]) AS k)
  UNION ALL SELECT doc_id, 1, r + 1, k, false, [p_partkey::VARCHAR, concat(p_name, ' & new'), p_type][k] FROM p, (SELECT unnest([1, 2, 3]) AS k)
  UNION ALL SELECT doc_id, 2, 1, 1, true, 'x' FROM b
) SELECT page_id, table_no::BIGINT AS table_no, row_no::BIGINT AS row_no, cell_no::BIGINT AS cell_no, head, text FROM h""",
    "html_nested_sections": r"""
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n, len(regexp_extract_all(html, '<h1[ >]')) AS tops FROM pages)
SELECT page_id, 0 AS level, 1 AS n, 0 AS deepest FROM c UNION ALL SELECT page_id, 1, tops, 1 FROM c WHERE tops > 0
UNION ALL SELECT page_id, 2, n, 2 FROM c WHERE n > 0 UNION ALL SELECT page_id, 3, n, 3 FROM c WHERE n > 0""",
    "html_meta": r"""SELECT page_id, 'charset' AS name, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS content FROM pages WHERE contains(html, '<meta charset="')""",
    "text_pages": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, (i // 5 + 1)::INT AS page_number, concat('Lines ', i // 5 * 5 + 1, '-', least((i // 5 + 1) * 5, n)) AS title, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM l GROUP BY doc_id, i // 5, n""",
    "text_counts": r"""
SELECT doc_id, length(text)::INT AS n_chars, len(string_split(text, chr(10)))::INT AS n_lines, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_words FROM documents""",
    "markdown_counts": r"""
WITH m AS (SELECT doc_id, concat('# Top of ', source, chr(10), replace(text, chr(10), concat(chr(10), chr(10), '## Part', chr(10), '- item', chr(10), '| a | b |', chr(10), '```', chr(10), 'x', chr(10), '```', chr(10)))) AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{1,6}\s+\S'))::INT AS n_headings, (len(regexp_extract_all(t, '(?m)^```')) // 2)::INT AS n_code_blocks, len(regexp_extract_all(t, '(?m)^\s*[-*+]\s+\S'))::INT AS n_list_items,
  len(regexp_extract_all(t, '(?m)^\s*\|.+\|\s*$'))::INT AS n_table_lines, len(list_filter(regexp_split_to_array(t, '\n{2,}'), lambda p: trim(p) <> ''))::INT AS n_paragraphs,
  regexp_extract(t, '(?m)^#{1,6}\s+(\S.*)$', 1) AS title FROM m""",
    "html_counts": r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, """
    + ", ".join(
        rf"len(regexp_extract_all(html, '(?i)<{tag}[\s>]'))::INT AS n_{name}"
        for tag, name in (("h[1-6]", "headings"), ("p", "paragraphs"), ("a", "links"), ("img", "images"), ("table", "tables"), ("meta", "meta"))
    )
    + " FROM pages",
    "json_properties": r"""
WITH c AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 5) ELSE props END AS p FROM events), v AS (SELECT *, json_valid(p) AS ok, substr(trim(p), 1, 1) AS k FROM c)
SELECT event_id, CASE WHEN NOT ok THEN NULL WHEN k = '{' THEN 'object' WHEN k = '[' THEN 'array' ELSE 'scalar' END AS root_type,
  CASE WHEN ok AND k = '{' THEN len(json_keys(p))::INT END AS element_count, CASE WHEN ok AND k = '{' THEN array_to_string(list_sort(json_keys(p)), ',') END AS top_level_keys,
  coalesce(len(regexp_extract_all(p, '[\[{]')) > 1, false) AS has_nested, CASE WHEN NOT ok THEN 'invalid' END AS error FROM v""",
    "csv_tables": """
WITH r AS (SELECT p_brand, p_partkey // 10000 AS block, p_partkey::VARCHAR AS k, concat(p_name, ', "new"', chr(10), 'or', chr(13), chr(10), 'old') AS n, p_type AS t FROM part),
c AS (SELECT p_brand, block, concat('key,name,type', chr(13), chr(10), string_agg(concat(k, ',"', replace(n, '"', '""'), '",', t), chr(13) || chr(10) ORDER BY k, n, t), chr(13), chr(10)) AS csv,
  list(concat(k, chr(1), replace(n, '"', '&quot;'), chr(1), t) ORDER BY k, n, t) AS rows, count(*) AS m FROM r GROUP BY 1, 2),
h AS (SELECT *, concat('<table>', array_to_string(list_transform(rows, lambda x, i: CASE WHEN i = 1 THEN concat('<tr><th>', replace(x, chr(1), '</th><th>'), '</th></tr>') ELSE concat('<tr><td>', replace(x, chr(1), '</td><td>'), '</td></tr>') END), ''), '</table>') AS html FROM c)
SELECT p_brand, block, md5(csv) AS csv_digest, md5(html) AS html_digest, (m + 1)::INT AS row_count, 'key,name,type' AS header, true AS same FROM h""",
    "file_checks": r"""
WITH f AS (SELECT 'document' AS kind, text AS c FROM documents UNION ALL SELECT 'page', html FROM pages UNION ALL SELECT 'event', props FROM events),
m AS (SELECT kind, strlen(c) AS n, CASE WHEN regexp_matches(lower(substr(c, 1, 32)), '^\s*<(!doctype html|html)') THEN 'text/html' WHEN regexp_matches(substr(c, 1, 32), '^\s*[\[{]') THEN 'application/json' ELSE 'text/plain' END AS mime FROM f)
SELECT kind, mime, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 4000 THEN 'too large' END, CASE WHEN n > 0 AND n < 4 THEN 'short header' END], lambda x: x IS NOT NULL), ',') AS errors, count(*) AS n, sum(n)::BIGINT AS n_bytes FROM m GROUP BY 1, 2, 3""",
    "title_heuristics": r"""
WITH f AS (SELECT doc_id, n_chars, string_split(text, chr(10))[1] AS l FROM documents)
SELECT doc_id, CASE WHEN length(l) < 100 AND NOT ends_with(l, '.') AND regexp_matches(l, '^[A-Z][a-z]') THEN l END AS title, n_chars % 9 > 0 AND 1.0 / nullif(n_chars % 9, 0) < 0.2 AS needs_ocr,
  try_strptime((20200101 + doc_id % 40)::VARCHAR, '%Y%m%d')::DATE AS created FROM f""",
}
