"""Retrieval queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.operators import retrieve as R
from tessera.operators.keyword import KeywordIndex
from tessera.plans.common import chunks, questions, table


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(chunks(spark, sf_dir)).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def bm25_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.document_frequency(R.postings(chunks(spark, sf_dir)))
    return df.crossJoin(F.broadcast(R.corpus_stats(chunks(spark, sf_dir)))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come after scoring and before the cut; statistics stay those of the corpus."""
    rows = chunks(spark, sf_dir)
    keep = R.predicate({"language": ["en", "fr"], "chunk_index": {"gte": 10}, "year": 2024, "document_id": None}, rows.columns, absent=True)
    return R.bm25(rows, questions(spark, sf_dir), 10, keep).select("query_id", "rank", "chunk_id", "score")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits from an index that is kept."""
    index = KeywordIndex(spark, shared_folder(spark))
    index.build(chunks(spark, sf_dir))
    return index.search(questions(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's vector is the one of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return _vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id").join(items, "query_id", "left_semi").select("query_id", "vector", "label")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is applied before the search."""
    vectors = _vectors(spark, sf_dir)
    return R.dense(vectors.filter(R.predicate({"label": {"lt": 5}}, vectors.columns)), _asked(spark, sf_dir), 5).select("query_id", "rank", "chunk_id", "score")


def _hybrid(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    return R.fuse(R.dense(_vectors(spark, sf_dir), _asked(spark, sf_dir), 3 * k), R.bm25(rows, asked, 3 * k), k, 0.5)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _hybrid(spark, sf_dir)
    return out.select("query_id", "rank", "chunk_id", "score", "retrieval_source", *(F.round(c, 6).alias(c) for c in ("normal_dense", "normal_bm25")))


def hybrid_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).filter("score >= 0.013").select("query_id", "rank", "chunk_id", "score")


def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    out = R.parents(R.bm25(rows, questions(spark, sf_dir), 30), rows, 10)
    return out.select("query_id", "rank", "document_id", "score", "n_matching", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    return R.rerank(R.bm25(rows, asked, 20), rows, asked, 10).select("query_id", "rank", "chunk_id", "score", "first_score")


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits of their user, with a date that some of them lack."""
    hits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "ts", F.round("value", 6).alias("score"), F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.lit(None).cast("string").alias("date")
    )
    return R.recency_boost(hits.filter("score IS NOT NULL"), 0.2, ["created_at", "date"]).select("query_id", "chunk_id", F.round("boosted", 6).alias("boosted"))


QUERIES = {
    "bm25_stats": bm25_stats,
    "bm25_document_frequency": bm25_document_frequency,
    "bm25_topk": bm25_topk,
    "bm25_index_topk": bm25_index,
    "bm25_filtered": bm25_filtered,
    "dense_topk": dense_topk,
    "dense_filtered": dense_filtered,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_min_score": hybrid_min_score,
    "parent_child": parent_child,
    "rerank_overlap": reranked,
    "recency_boost": recency,
}

TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{{2,}}'))"
BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, {TOKENS.format("text")} AS toks FROM documents),
stats AS (SELECT count(*) AS n, coalesce(sum(len(toks)), 0)::DOUBLE / greatest(count(*), 1) AS avgdl FROM tok),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm25 AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
  FROM terms JOIN dfs USING (term) JOIN post USING (term), stats GROUP BY query_id, chunk_id
)"""
UNITS = """
units AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
cosines AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, round(list_dot_product(q.v, c.v), 6) AS score
  FROM units q JOIN benchmark b ON q.vec_id = b.item_id, units c)"""


def _top(source: str, k: int, tie: str = "chunk_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k})"


FUSED = f"""
d AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normal
  FROM {_top("cosines", 30)} WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normal
  FROM {_top("bm25", 30)} WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.rank AS rd, b.rank AS rb, d.normal AS nd, b.normal AS nb
  FROM d FULL JOIN b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
s AS (SELECT query_id, chunk_id, round(0.5 / (60 + coalesce(rd, count(rd) OVER w + 1)) + 0.5 / (60 + coalesce(rb, count(rb) OVER w + 1)), 9) AS score,
  CASE WHEN rd IS NULL THEN 'bm25' WHEN rb IS NULL THEN 'dense' ELSE 'hybrid' END AS retrieval_source,
  round(coalesce(nd, 0)::DOUBLE, 6) AS normal_dense, round(coalesce(nb, 0)::DOUBLE, 6) AS normal_bm25 FROM f WINDOW w AS (PARTITION BY query_id))"""

SQL = {
    "bm25_stats": f"WITH t AS (SELECT len({TOKENS.format('text')}) AS dl FROM documents) SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(sum(dl)::DOUBLE / greatest(count(*), 1), 6) AS avgdl FROM t",
    "bm25_document_frequency": f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats",
    "bm25_topk": f"WITH {BM25} SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('bm25', 10)}",
    "bm25_index_topk": f"WITH {BM25} SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('bm25', 10)}",
    "bm25_filtered": f"WITH {BM25}, k AS (SELECT m.* FROM bm25 m JOIN documents d ON m.chunk_id = d.doc_id WHERE lang IN ('en', 'fr') AND doc_id >= 10) SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('k', 10)}",
    "dense_topk": f"WITH {UNITS} SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('cosines', 10)}",
    "dense_filtered": f"WITH {UNITS}, k AS (SELECT * FROM cosines WHERE label < 5) SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('k', 5)}",
    "hybrid_rrf": f"WITH {BM25}, {UNITS}, {FUSED} SELECT query_id, rank::INT AS rank, chunk_id, score, retrieval_source, normal_dense, normal_bm25 FROM {_top('s', 10)}",
    "hybrid_min_score": f"WITH {BM25}, {UNITS}, {FUSED} SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('s', 10)} WHERE score >= 0.013",
    "parent_child": f"""
WITH {BM25}, h AS (SELECT b.*, d.source AS document_id, d.text, row_number() OVER (PARTITION BY query_id, d.source ORDER BY score DESC, chunk_id) AS place FROM {_top("bm25", 30)} b JOIN documents d ON b.chunk_id = d.doc_id),
r AS (SELECT query_id, document_id, max(score) AS score, count(*) AS n_matching, string_agg('[Page ?] ' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_id) FILTER (WHERE place <= 3) AS text FROM h GROUP BY ALL)
SELECT query_id, rank::INT AS rank, document_id, score, n_matching, length(text)::INT AS n_chars, md5(text) AS digest FROM {_top("r", 10, "document_id")}""",
    "rerank_overlap": f"""
WITH {BM25}, p AS (SELECT h.query_id, h.chunk_id, h.score AS first_score, list_distinct({TOKENS.format("b.text")}) AS q, {TOKENS.format("d.text")} AS t FROM {_top("bm25", 20)} h JOIN benchmark b ON h.query_id = b.item_id JOIN documents d ON h.chunk_id = d.doc_id),
r AS (SELECT query_id, chunk_id, first_score, round(len(list_filter(q, lambda x: list_contains(t, x)))::DOUBLE / greatest(len(q), 1), 6) AS score FROM p)
SELECT query_id, rank::INT AS rank, chunk_id, score, first_score FROM {_top("r", 10)}""",
    "recency_boost": """
WITH h AS (SELECT user_id AS query_id, event_id AS chunk_id, round(value, 6) AS score, CASE WHEN event_type <> 'error' THEN floor(epoch(ts))::BIGINT END AS t FROM events WHERE value IS NOT NULL)
SELECT query_id, chunk_id, round(CASE WHEN t IS NULL THEN score ELSE score * (1 + 0.2 * ((t - min(t) OVER w)::DOUBLE / greatest(max(t) OVER w - min(t) OVER w, 1))) END, 6) AS boosted FROM h WINDOW w AS (PARTITION BY query_id)""",
}
