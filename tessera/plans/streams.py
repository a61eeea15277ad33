"""Streams over the whole event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.operators.keyword import KeywordIndex
from tessera.plans.relational import JOB_STATUS
from tessera.streaming import live as L
from tessera.streaming.cache import ROCKS, cached


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stream_of(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.result(L.counts(_events(spark, sf_dir), "1 hour"), "update", ["user_id", "w"])
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.result(L.counts(_events(spark, sf_dir), "1 hour", "30 minutes", key="event_type"), "update", ["event_type", "w"])
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.result(L.session_counts(_events(spark, sf_dir)), "complete")
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first"), "n")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")
    return L.result(L.limited(requests, 2, 86_400), "append").select("request_id", "n", "allowed", "retry_after")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for pair in JOB_STATUS.items() for x in pair))[F.col("event_type")]
    events = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), status.alias("status"), "ts", "event_id")
    return L.result(L.job_states(events), "update", ["job_id"])


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of new chunks of a keyword index."""
    folder = shared_folder(spark)
    kept = KeywordIndex(spark, f"{folder}/index")
    docs = L.stream_of(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(0).alias("seq"))
    L.drained(docs, "append", kept.writer(), f"{folder}/checkpoint")
    return kept.status().select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all documents, new texts of a third of them and removals of a fifth, in that order; what the index says at its end.

    Three batches make three segments, which are merged; frequencies and totals
    are sums over segments all along.
    """
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    new = docs.filter("chunk_id % 3 = 0").select("chunk_id", F.concat_ws(" ", "source", "text").alias("text"), F.lit(1).alias("seq"))
    gone = docs.filter("chunk_id % 5 = 0").select("chunk_id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("seq"))
    kept = KeywordIndex(spark, f"{folder}/index")
    for number, rows in enumerate((docs.select("chunk_id", "text", F.lit(0).alias("seq")), new, gone)):
        # the files of one write are one batch: the stream goes on where it stopped
        rows.write.mode("append").parquet(f"{folder}/changes")
        L.drained(L.stream_of(spark, f"{folder}/changes"), "append", kept.writer(), f"{folder}/checkpoint")
        if number == 1:
            kept.merge(2)
    totals = kept.status().select("n", "total")
    return kept.frequencies().crossJoin(F.broadcast(totals))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    rows = _events(spark, sf_dir).withColumn("retry_count", (F.col("event_id") % 5).cast("int"))
    L.drained(rows, "append", L.with_dead_letters(f"{folder}/good", f"{folder}/bad", "event_type = 'error'"), f"{folder}/checkpoint")
    counted = lambda name: spark.read.parquet(f"{folder}/{name}").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("queue", F.lit(name))
    return counted("good").unionByName(counted("bad")).select("queue", "event_type", "n")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lookups of their user in a cache whose entries live six hours from their last use."""
    lookups = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    found = L.result(cached(lookups, 6 * 3600), "append", settings=ROCKS)
    return found.select("key", "request_id", "hit", F.round("idle", 3).alias("idle"))


QUERIES = {
    "stream_windows": windows,
    "stream_sliding": sliding,
    "stream_sessions": sessions,
    "stream_rate_limit": limits,
    "stream_cache": cache,
    "stream_job_states": jobs,
    "stream_index": index,
    "stream_index_changes": index_changes,
    "stream_dead_letters": dead_letters,
}
_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))"
SQL = {
    "stream_windows": "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": """
SELECT event_type, start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS start FROM events UNION ALL SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' FROM events) GROUP BY 1, 2""",
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_rate_limit": """
WITH r AS (SELECT event_id AS request_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 86400 ORDER BY ts, event_id) AS n FROM events)
SELECT request_id, n, n <= 2 AS allowed, 86400 - t % 86400 AS retry_after FROM r""",
    "stream_cache": """
WITH u AS (SELECT user_id AS key, event_id AS request_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idle FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT key, request_id, coalesce(idle < 21600000, false) AS hit, CASE WHEN idle < 21600000 THEN round(idle / 1000.0, 3)::DOUBLE END AS idle FROM u""",
    "stream_index": f"""
WITH t AS (SELECT len({_TOKENS}) AS dl FROM documents) SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(sum(dl)::DOUBLE / greatest(count(*), 1), 6) AS avgdl FROM t""",
    "stream_index_changes": f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', source, text) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
t AS (SELECT doc_id, {_TOKENS} AS w FROM d), s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM t)
SELECT term, count(DISTINCT doc_id) AS df, any_value(n) AS n, any_value(total) AS total FROM (SELECT doc_id, unnest(w) AS term FROM t), s GROUP BY term""",
    "stream_dead_letters": "SELECT CASE WHEN event_type = 'error' AND event_id % 5 >= 3 THEN 'bad' ELSE 'good' END AS queue, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
