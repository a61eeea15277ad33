"""Context assembly and chat history over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import retrieve as R
from tessera.plans.common import chunks, questions, table
from tessera.plans.retrieval import BM25, _top


def _hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return R.bm25(rows, questions(spark, sf_dir), k).join(rows, "chunk_id").select("query_id", "chunk_id", "document_id", "chunk_index", "text", "score", "rank")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical hits of events' users: each event type once, with its highest value."""
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    hits = events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id"), F.round("value", 6).alias("score"), F.col("event_id").alias("rank"))
    return C.best_per_chunk(hits).select("query_id", "chunk_id", "score", "rank")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as chunks, each place once; some places are not retrieved, so that there are runs."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_quantity", "l_partkey", "l_returnflag")))
    lines = lines.filter("l_quantity > 10")
    return lines.select(
        F.col("l_suppkey").alias("query_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("chunk_index"), F.concat_ws(" ", "l_partkey", "l_returnflag").alias("text"), F.col("l_quantity").alias("score"),
    )


def _merged(full_run: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _order_lines(spark, sf_dir).withColumn("query_id", F.lit(1))
        return C.merge_neighbours(rows, full_run).select("document_id", "chunk_index", "chunk_id", "score", "n_merged", "text")

    return run


def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of documents and places."""
    kept = C.char_budget(_hits(spark, sf_dir), 2000, [F.col("document_id"), F.col("chunk_index")])
    return kept.select("query_id", "source_no", "chunk_id", "used", F.md5(F.col("text").cast("binary")).alias("digest"))


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_budget(_hits(spark, sf_dir), 1500).select("query_id", "source_no", "chunk_id", "used")


def document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.per_document_cap(_hits(spark, sf_dir)).select("query_id", "chunk_id", "document_id")


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diverse(_hits(spark, sf_dir)).select("query_id", "chunk_id", "score")


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assembly: best per chunk, diverse, within the budget, numbered, as text."""
    rows = C.token_budget(C.diverse(C.best_per_chunk(_hits(spark, sf_dir))), 3000)
    return C.context_text(rows).select("query_id", "n_sources", F.length("context").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.citations(C.token_budget(_hits(spark, sf_dir), 3000))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' numbers as citations inside a sentence."""
    cited = F.format_string("As shown [%d] and [%d-%d], also [%d,%d].", F.col("event_id") % 7 + 1, F.col("user_id") % 5 + 1, F.col("user_id") % 9 + 3, F.col("event_id") % 4 + 1, F.col("event_id") % 11 + 1)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(C.citation_numbers(cited), ",").alias("cited"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(table(spark, sf_dir, "conversations"), 400).select("conv_id", "turn", "back", "used")


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prices as model windows."""
    limit = F.floor("o_totalprice").cast("int") + 2048
    got = C.allocation(limit)
    return table(spark, sf_dir, "orders").select("o_orderkey", *(got[c].alias(c) for c in ("effective", "context", "response", "system", "history")))


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.truncated(F.col("text"), F.lit(200))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("n_chars"), F.md5(cut.cast("binary")).alias("digest"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        C.header(F.col("doc_id"), F.nullif(F.col("lang"), F.lit("de")), F.when(F.col("n_chars") > 1000, F.col("n_chars"))).alias("header"),
        C.rich_header(F.col("doc_id"), F.when(F.col("lang") != "fr", F.col("source")), F.col("doc_id"), F.col("n_chars") / 1000).alias("rich"),
    )


QUERIES = {
    "context_dedup": dedup,
    "neighbour_merge_pairs": _merged(False),
    "neighbour_merge_runs": _merged(True),
    "context_char_budget": char_budget,
    "context_token_budget": token_budget,
    "context_document_cap": document_cap,
    "context_diversity": diversity,
    "context_text": context,
    "context_citations": citations,
    "citation_numbers": citation_numbers,
    "chat_history": history,
    "budget_allocation": allocations,
    "budget_truncation": truncation,
    "context_headers": headers,
}

_HITS = f"{BM25}, hits AS (SELECT b.*, d.source AS document_id, d.doc_id AS chunk_index, d.text FROM {_top('bm25', 10)} b JOIN documents d ON b.chunk_id = d.doc_id)"
_TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"


def _merge_sql(pair: str) -> str:
    return f"""
WITH l AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, concat_ws('-', l_orderkey, l_linenumber) AS chunk_id, l_quantity AS score, concat_ws(' ', l_partkey, l_returnflag) AS text
  FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) WHERE l_quantity > 10),
r AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS run FROM l),
p AS (SELECT *, {pair} AS pair FROM r)
SELECT document_id, min(chunk_index)::INT AS chunk_index, min_by(chunk_id, chunk_index) AS chunk_id, max(score) AS score, count(*) AS n_merged, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text
FROM p GROUP BY document_id, run, pair"""


SQL = {
    "context_dedup": """
SELECT query_id, chunk_id, score, rank FROM (SELECT user_id AS query_id, event_type AS chunk_id, round(value, 6) AS score, event_id AS rank,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY round(value, 6) DESC, event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n = 1""",
    "neighbour_merge_pairs": _merge_sql("(row_number() OVER (PARTITION BY document_id, run ORDER BY chunk_index) - 1) // 2"),
    "neighbour_merge_runs": _merge_sql("0"),
    "context_char_budget": f"""
WITH {_HITS}, u AS (SELECT *, row_number() OVER w AS source_no, sum(length(text) + 80) OVER w AS used FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY document_id, chunk_index))
SELECT query_id, source_no::INT AS source_no, chunk_id, used::BIGINT AS used, md5(CASE WHEN source_no = 1 AND used > 8000 THEN concat(substr(text, 1, 7920), '...') ELSE text END) AS digest FROM u WHERE used <= 8000 OR source_no = 1""",
    "context_token_budget": f"""
WITH {_HITS}, u AS (SELECT *, row_number() OVER w AS source_no, sum({_TOKENS}) OVER w AS used FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id))
SELECT query_id, source_no::INT AS source_no, chunk_id, used::BIGINT AS used FROM u WHERE used <= 1500 OR source_no = 1""",
    "context_document_cap": f"""
WITH {_HITS} SELECT query_id, chunk_id, document_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS place FROM hits)
WHERE place <= greatest(2, n // 3)""",
    "context_citations": f"""
WITH {_HITS}, u AS (SELECT *, row_number() OVER w AS source_no, sum({_TOKENS}) OVER w AS used FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id))
SELECT query_id, source_no::INT AS index, chunk_id, document_id, score, substr(text, 1, 200) AS preview FROM u WHERE used <= 3000 OR source_no = 1""",
    "citation_numbers": """
WITH n AS (SELECT event_id, event_id % 7 + 1 AS one, user_id % 5 + 1 AS a, user_id % 9 + 3 AS b, event_id % 4 + 1 AS c, event_id % 11 + 1 AS d FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat([one, c, d], CASE WHEN a <= b AND b - a < 20 THEN range(a, b + 1) ELSE [] END))), ',') AS cited FROM n""",
    "chat_history": f"""
WITH u AS (SELECT *, row_number() OVER w AS back, sum({_TOKENS} + 4) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, back::INT AS back, used::BIGINT AS used FROM u WHERE back <= 12 AND used <= 400""",
    "budget_allocation": """
WITH e AS (SELECT o_orderkey, floor(o_totalprice)::INT + 2048 - 512 AS effective FROM orders),
p AS (SELECT *, floor(effective * 0.6::DOUBLE)::INT AS context, floor(effective * 0.25::DOUBLE)::INT AS response FROM e)
SELECT o_orderkey, effective, context, response, 1024 AS system, greatest(effective - context - response - 1024, 0)::INT AS history FROM p""",
    "budget_truncation": f"""
WITH t AS (SELECT doc_id, text, {_TOKENS} AS n FROM documents),
c AS (SELECT doc_id, CASE WHEN n <= 200 THEN text ELSE concat(substr(text, 1, floor(length(text) * 200::DOUBLE / n)::INT), chr(10), '[Content truncated]') END AS t FROM t)
SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM c""",
    "context_headers": """
SELECT doc_id, concat_ws(' | ', concat('[Source ', doc_id, ']'), nullif(lang, 'de'), CASE WHEN n_chars > 1000 THEN concat('Page ', n_chars) END) AS header,
  concat('[', doc_id, '] ', coalesce(nullif(CASE WHEN lang <> 'fr' THEN source END, ''), concat('Document ', substr(doc_id::VARCHAR, 1, 8))), printf(' (score %.3f)', n_chars / 1000.0::DOUBLE)) AS rich FROM documents""",
}
