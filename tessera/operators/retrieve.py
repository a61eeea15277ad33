"""Retrieval of whole batches of queries: BM25, exact cosine, rank fusion, roll-up, reranking, filters."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import saved
from tessera.functions.tokens import bm25_tokens, counted_terms
from tessera.operators.products import weighted_terms, with_few, with_many

#: A side is broadcast up to so many rows; beyond, joins shuffle both sides.
MOST_BROADCAST = 200_000
#: And up to so many bytes, as written in JSON.
MOST_BYTES = 64_000_000
K1, B, RRF = 1.5, 0.75, 60


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The same rows, to be broadcast if their number and their size, both measured, are small."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    rows, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and total <= MOST_BYTES else df


def top(hits: DataFrame, k: int, per: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k highest scores of each query with their rank, ties to the smaller id."""
    window = Window.partitionBy(per).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


#: Up to so many terms are looked for within each chunk's tokens; more are joined.
MOST_LISTED = 10_000


def lengths_and_terms(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf): of each chunk its length and the counts of the wanted terms; one row with a null term if it has none of them.

    Each chunk is read and tokenized once. Its tokens become rows only where
    they are wanted, counted already, and nothing is shuffled; only a set of
    terms that is too large to list is joined. Each row of chunks counts for
    itself.
    """
    tokens = chunks.select("chunk_id", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).select("chunk_id", F.size("tokens").alias("dl"), "tokens")
    listed = [r["term"] for r in wanted.select("term").limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:
        held = F.filter("tokens", lambda x: x.isin(*listed)) if listed else F.array().cast("array<string>")
        found = tokens.select("chunk_id", "dl", F.explode_outer(counted_terms(held)).alias("t"))
        return found.select("chunk_id", "dl", "t.term", F.col("t.tf").cast("long").alias("tf"))
    words = tokens.select("chunk_id", "dl", F.explode_outer(counted_terms(F.col("tokens"))).alias("t")).select("chunk_id", "dl", "t.*")
    marked = words.join(small(wanted.select("term", F.lit(True).alias("asked"))), "term", "left")
    return marked.groupBy("chunk_id", "dl", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf): an inverted index with each chunk's length."""
    tokens = chunks.select("chunk_id", bm25_tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    return tokens.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n, total and average length, chunks without tokens included."""
    return stats_of(chunks.select("chunk_id", F.size(bm25_tokens(F.col("text"))).alias("dl")))


def stats_of(lengths: DataFrame) -> DataFrame:
    """One row: n, total and average of the lengths (dl), one row a chunk."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avgdl", F.col("total") / F.greatest(F.col("n"), F.lit(1)))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) from postings (chunk_id, dl, term, tf) of all terms (query_id, term) and the corpus's stats."""
    weighted = terms.join(document_frequency(index), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1)))
    hits = index.join(small(weighted), "term").select("query_id", "chunk_id", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("part"))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return scored if k is None else top(scored, k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None = 10, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of all queries (query_id, query) at once; chunk_id and query_id are one row's each.

    The corpus is read and tokenized once: each chunk leaves its length and its
    counts of the queries' terms, which are written to the checkpoint folder;
    statistics are counted from these. Statistics are those of the whole corpus,
    `keep` filters chunks after scoring and before the cut. If the questions'
    weights are few, by their counted numbers, all questions are scored by a
    matrix product in each task, which sends its best only; else, or for all
    scores, postings are joined.
    """
    terms = saved(queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("query")))).alias("term")))
    wanted = terms.select("term").distinct()
    if k is not None and (numbers := wanted.limit(MOST_LISTED + 1).count()) <= MOST_LISTED:
        n_queries = terms.select("query_id").distinct().count()
        if numbers * n_queries <= MOST_NUMBERS:
            return _bm25_few(chunks, terms, k, keep)
    read = saved(lengths_and_terms(chunks, wanted))
    stats = stats_of(read.groupBy("chunk_id").agg(F.first("dl").alias("dl")))
    index = read.filter("term IS NOT NULL")
    scored = bm25_scores(index, stats, terms, None)
    if keep is not None:
        scored = scored.join(chunks.filter(keep).select("chunk_id"), "chunk_id", "left_semi")
    return scored if k is None else top(scored, k)


def share(tf, dl, avgdl: float):
    """A term's part of a score but for its weight, of numbers or arrays of numpy."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / max(avgdl, 1)))


def _bm25_few(chunks: DataFrame, terms: DataFrame, k: int, keep: Column | None) -> DataFrame:
    asked = terms.collect()
    listed = sorted({r["term"] for r in asked})
    tokens = chunks.select("chunk_id", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("kept"))
    held = F.filter("tokens", lambda x: x.isin(*listed)) if listed else F.array().cast("array<string>")
    read = saved(tokens.select("chunk_id", "kept", F.size("tokens").alias("dl"), held.alias("held")).select("chunk_id", "kept", "dl", counted_terms(F.col("held")).alias("terms")))
    n, total, avgdl = stats_of(read).first()
    df = dict(read.select(F.explode("terms").alias("t")).groupBy("t.term").count().collect())
    places = {q: i for i, q in enumerate(sorted({r["query_id"] for r in asked}))}
    weights = [(places[r["query_id"]], r["term"], math.log(1 + (n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5))) for r in asked if r["term"] in df]
    kind = terms.schema["query_id"].dataType.simpleString()
    found = weighted_terms(read.filter("kept"), weights, list(places), kind, avgdl, share, k)
    return top(found.withColumn("score", F.round("score", 6)), k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Up to so many numbers of query vectors go to every task as one matrix.
MOST_NUMBERS = 4_000_000


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine of each query (query_id, vector) with all vectors (chunk_id, vector).

    Queries are a stated set that meets all vectors. A small set, by its
    counted numbers, is one matrix in every task. A larger one is dealt into
    blocks that meet blocks of vectors, a matrix product a pair. Either way
    tasks send their best of each query only. Scores are rounded to six places
    by Spark. Vectors and queries that are null, of length zero, or hold null or
    non-finite components have no direction and take no part; a query and a
    vector of other length have no score.
    """
    queries = queries.filter(F.col("query_id").isNotNull() & directed(F.col("vector")))
    vectors = vectors.filter(directed(F.col("vector")))
    n, numbers = queries.agg(F.count("query_id"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    found = with_few(vectors, queries, k) if numbers <= MOST_NUMBERS else with_many(vectors, queries, k, n)
    return top(found.withColumn("score", F.round("score", 6)), k)


def directed(vector: Column) -> Column:
    """Whether a vector has a direction: it is there, all components are finite, and one is not zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("normal", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(dense_hits: DataFrame, bm25_hits: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """Weighted reciprocal ranks of both lists; what one list lacks ranks one below its end, counted from 60 again."""
    both = min_max(dense_hits).select("query_id", "chunk_id", F.col("rank").alias("rank_dense"), F.col("normal").alias("normal_dense")).join(
        min_max(bm25_hits).select("query_id", "chunk_id", F.col("rank").alias("rank_bm25"), F.col("normal").alias("normal_bm25")), ["query_id", "chunk_id"], "full_outer"
    )
    w = Window.partitionBy("query_id")
    absent = lambda rank: F.coalesce(F.col(rank), F.count(rank).over(w) + 1)
    score = alpha / (RRF + absent("rank_dense")) + (1 - alpha) / (RRF + absent("rank_bm25"))
    origin = F.when(F.col("rank_dense").isNull(), "bm25").when(F.col("rank_bm25").isNull(), "dense").otherwise("hybrid")
    fused = both.select(
        "query_id", "chunk_id", F.round(score, 9).alias("score"), origin.alias("retrieval_source"), F.coalesce("normal_dense", F.lit(0.0)).alias("normal_dense"), F.coalesce("normal_bm25", F.lit(0.0)).alias("normal_bm25")
    )
    return top(fused, k)


def recency_boost(hits: DataFrame, boost: float, dates: list[str]) -> DataFrame:
    """score * (1 + boost * age share) by the first readable of the date columns; undated hits stay."""
    ts = F.unix_timestamp(F.coalesce(*(F.try_to_timestamp(F.col(c).cast("string")) for c in dates)))
    w = Window.partitionBy("query_id")
    hits = hits.withColumn("_ts", ts)
    low, high = F.min("_ts").over(w), F.max("_ts").over(w)
    share = (F.col("_ts") - low) / F.greatest(high - low, F.lit(1))
    return hits.withColumn("boosted", F.when(F.col("_ts").isNull(), F.col("score")).otherwise(F.col("score") * (1 + boost * share))).drop("_ts")


def parents(hits: DataFrame, chunks: DataFrame, k: int = 10, per_document: int = 3) -> DataFrame:
    """Documents by their best chunk: score, matching chunks, and the best chunks' texts in order."""
    best = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id")
    held = hits.select("query_id", "chunk_id", "score").join(chunks.select("chunk_id", "document_id", "chunk_index", "text"), "chunk_id").withColumn("place", F.row_number().over(best))
    line = F.when(F.col("place") <= per_document, F.struct("chunk_index", F.concat(F.lit("[Page ?] \n"), "text").alias("text")))
    rolled = held.groupBy("query_id", "document_id").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("n_matching"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    return top(rolled.select("query_id", "document_id", "score", "n_matching", F.array_join(F.transform("lines", lambda s: s["text"]), "\n\n").alias("text")), k, tie="document_id")


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, first: int = 100, scorer=None) -> DataFrame:
    """The first candidates scored anew by (query, text); without a scorer by the share of the query's words in the text."""
    scorer = scorer or (lambda q, t: F.size(F.array_intersect(bm25_tokens(q), bm25_tokens(t))) / F.greatest(F.size(F.array_distinct(bm25_tokens(q))), F.lit(1)))
    pairs = hits.filter(F.col("rank") <= first).select("query_id", "chunk_id", F.col("score").alias("first_score"))
    pairs = pairs.join(small(queries.select("query_id", "query")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return top(pairs.select("query_id", "chunk_id", "first_score", F.round(scorer(F.col("query"), F.col("text")), 6).alias("score")), k)


def predicate(filters: dict[str, Any], columns: list[str], absent: bool = False) -> Column:
    """A filter dictionary as one condition: values, lists, ranges (gte, lte, gt, lt); None and unknown columns pass.

    A key may name a part of a column ("metadata.year"). Rows where the value is
    null pass only if `absent` is true: those lack the key.
    """
    ops = {"gte": "__ge__", "lte": "__le__", "gt": "__gt__", "lt": "__lt__"}
    out = F.lit(True)
    for key, value in filters.items():
        if value is None or (key not in columns and key.partition(".")[0] not in columns):
            continue
        held, passes = F.col(key), F.lit(True)
        if isinstance(value, dict):
            for op, bound in value.items():
                passes &= getattr(held, ops[op])(bound)
        elif isinstance(value, (list, tuple)):
            passes = held.isin(*value) if value else F.lit(True)
        elif isinstance(value, (str, int, float, bool)):
            passes = held == F.lit(value)
        else:
            raise ValueError(f"no filter on {key} by {type(value).__name__}")
        out &= F.coalesce(passes, F.lit(absent))
    return out


def filter_errors(filters: dict[str, Any]) -> list[str]:
    """What is wrong with a filter dictionary."""
    out = []
    for key, value in filters.items():
        if value is None:
            out.append(f"{key}: null")
        elif isinstance(value, (list, tuple)) and not value:
            out.append(f"{key}: empty list")
        elif isinstance(value, dict) and (unknown := sorted(set(value) - {"gte", "lte", "gt", "lt"})):
            out.append(f"{key}: {', '.join(unknown)}")
    return out
