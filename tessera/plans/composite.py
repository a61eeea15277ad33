"""Whole paths: ingest documents, index their chunks, search, judge answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chunk, clean, query, tokens
from tessera.operators import context as C
from tessera.operators import embed as M
from tessera.operators import retrieve as R
from tessera.plans.common import chunks, questions, table
from tessera.plans.retrieval import BM25, _asked, _top, _vectors


def ingest(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) cleaned, with their language, in chunks."""
    ready = clean.clean_column(docs, "text")
    ready = ready.withColumn("language", tokens.language(F.col("text"))["language"])
    return chunk.chunk_documents(ready)


def search(queries: DataFrame, rows: DataFrame, vectors: DataFrame, asked: DataFrame, k: int = 10, rerank: bool = True, budget: int = 3000, alpha: float = 0.5) -> DataFrame:
    """Rewritten questions, both retrievals, fusion, reranking, context: one row a question."""
    rewritten = queries.select("query_id", query.rewrite(F.col("query")).alias("query"))
    depth = 2 * k if rerank else k
    hits = R.fuse(R.dense(vectors, asked, depth), R.bm25(rows, rewritten, depth), depth, alpha)
    hits = R.rerank(hits, rows, rewritten, k) if rerank else hits
    full = hits.select("query_id", "chunk_id", "score", "rank").join(rows, "chunk_id")
    return C.context_text(C.token_budget(C.diverse(C.best_per_chunk(full)), budget))


def ingest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", "chunk_type", "language", "char_count", "content_checksum")


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(questions(spark, sf_dir), chunks(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir))
    return out.select("query_id", "n_sources", F.length("context").alias("n_chars"))


def index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table is the cache of the documents of its ids; other contents are embedded, each once."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    held = table(spark, sf_dir, "embeddings").join(rows, F.col("vec_id") == F.col("chunk_id")).groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    cache = held.withColumn("model", F.lit("hash")).withColumn("dimension", F.lit(64)).withColumn("last_access", now)
    out = M.index_chunks(rows, cache, M.hashing_provider(64), "hash", 64, now)
    return out.select("chunk_id", "checksum", "cached", "error", F.size("vector").alias("dimension"))


def overlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading of retrieval quality by depth: hits of planted documents among the first 1, 5 and 20 of BM25."""
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    run = R.bm25(rows, asked, 20)
    texts = rows.select("chunk_id", "text")
    hit = run.join(texts, "chunk_id").join(R.small(asked), "query_id").filter(F.contains("text", "query"))
    return hit.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in (1, 5, 20)))


QUERIES = {"ingest_pipeline": ingest_all, "search_pipeline": search_all, "index_chunks": index_all, "planted_hits": overlap_grid}
SQL = {
    "index_chunks": """
WITH c AS (SELECT DISTINCT text FROM documents JOIN embeddings ON doc_id = vec_id)
SELECT doc_id AS chunk_id, sha256(d.text) AS checksum, c.text IS NOT NULL AS cached, NULL AS error, 64 AS dimension FROM documents d LEFT JOIN c ON d.text = c.text""",
    "planted_hits": f"""
WITH {BM25} SELECT query_id, count(*) FILTER (WHERE rank <= 1) AS hits_1, count(*) FILTER (WHERE rank <= 5) AS hits_5, count(*) FILTER (WHERE rank <= 20) AS hits_20
FROM {_top("bm25", 20)} JOIN documents d ON chunk_id = d.doc_id JOIN benchmark b ON query_id = b.item_id WHERE contains(d.text, b.text) GROUP BY query_id""",
}
