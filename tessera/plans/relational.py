"""Repositories, jobs, caches and rate limits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.operators import retrieve as R
from tessera.operators import store as S
from tessera.operators.snapshots import Units, replace_documents
from tessera.plans.common import table
from tessera.sources import extract as X


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over orders as jobs: one pass of conditional aggregates."""
    s = F.col("o_orderstatus")
    done, failed = F.count_if(s == "F"), F.count_if(s == "P")
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "O").alias("active"), done.alias("completed"), failed.alias("failed"),
        F.round(100.0 * done / F.count(F.lit(1)), 1).alias("progress"), F.round(done / F.greatest(done + failed, F.lit(1)), 4).alias("hit_rate"),
    )


def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty of the open orders, newest first, with the number of pages."""
    rows = S.find_by(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=None)
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 50)).cast("long").alias("pages"))
    return S.page(rows, 2, 50, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_orderdate").crossJoin(F.broadcast(pages))


def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return S.latest(rows, "o_custkey", ["o_orderdate", "o_orderkey"])


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.next_version(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, lists, ranges, nulls and unknown keys."""
    parts = table(spark, sf_dir, "part")
    keep = R.predicate({"p_brand": ["Brand#11", "Brand#23", "Brand#45"], "p_size": {"gte": 5, "lt": 40}, "p_type": None, "colour": "red", "p_name": []}, parts.columns)
    return parts.filter(keep).select("p_partkey", "p_brand", "p_size")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even sources are there; of the others those of new content come in."""
    docs = table(spark, sf_dir, "documents")
    there = docs.filter(F.substring("source", 4, 2).cast("int") % 2 == 0)
    new = docs.filter(F.substring("source", 4, 2).cast("int") % 2 == 1).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return S.reject_duplicates(new, there).select("doc_id", "checksum")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of labels up to 3 are written anew with another label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    new = rows.filter("label <= 3").select((F.col("chunk_id") + 1).alias("chunk_id"), F.lit(99).alias("label"))
    return S.upsert(rows, new)


def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    labelled = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return S.delete(rows, labelled, {"label": {"gte": 2}})


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are cut or hold what is not a number."""
    v = F.col("embedding").cast("array<double>")
    broken = (
        F.when(F.col("vec_id") % 7 == 1, F.slice(v, 1, 10))
        .when(F.col("vec_id") % 7 == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")))))
        .when(F.col("vec_id") % 7 == 3, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("inf")))))
        .when(F.col("vec_id") % 7 == 4, F.slice(v, 1, 0))
        .otherwise(v)
    )
    return table(spark, sf_dir, "embeddings").groupBy(S.vector_errors(broken, 64).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def repeated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal whole vectors once rounded to six places, each vector being there again under another id."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return S.repeated_vectors(rows.unionByName(rows.withColumn("chunk_id", -1 - F.col("chunk_id"))))


def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(S.text_errors(F.col("text")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views fill the cache, purchases ask it a day later; props are the content."""
    events = table(spark, sf_dir, "events").withColumn("checksum", F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").cast("binary")))
    events = events.withColumn("model", F.lit("hash")).withColumn("dimension", F.lit(64))
    filled = events.filter("event_type IN ('click', 'view')").withColumn("checksum", F.md5(F.col("user_id").cast("string").cast("binary")))
    cache = filled.groupBy(*S.CACHE_KEY).agg(F.max("ts").alias("last_access"), F.max_by("event_id", F.struct("ts", "event_id")).alias("vector_id"))
    wanted = events.filter("event_type = 'purchase'").select("event_id", F.md5(F.col("user_id").cast("string").cast("binary")).alias("checksum"), "model", "dimension")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    hits, misses = S.cache_lookup(wanted, cache, now, 86_400 * 2)
    return hits.select("event_id", "vector_id").unionByName(misses.select("event_id", F.lit(None).cast("long").alias("vector_id")))


JOB_STATUS = {"signup": "queued", "view": "processing", "click": "embedding", "purchase": "completed", "error": "failed"}


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the status events of a job."""
    status = F.create_map(*(F.lit(x) for pair in JOB_STATUS.items() for x in pair))[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), "ts", "event_id")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.judged_transitions(_jobs(spark, sf_dir)).select("event_id", "job_id", "before", "status", "allowed")


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last status, its failures and what the next one makes of it."""
    rows = _jobs(spark, sf_dir).groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("n")
    )
    return rows.select("job_id", "status", "failures", S.after_failure(F.col("failures") % 4, F.lit(3)).alias("next"), S.progress(F.col("done"), F.col("n")).alias("progress"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user in a minute beyond the second; retry after the rest of the minute."""
    minute = F.floor(F.unix_timestamp("ts") / 3600)
    rank = F.row_number().over(Window.partitionBy("user_id", "minute").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("minute", minute).withColumn("n", rank)
    return rows.filter("n > 1").select("event_id", "user_id", "n", (3600 - F.unix_timestamp("ts") % 3600).alias("retry_after"))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return rows.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


def metrics_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, gauges and timings of each event type."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_timed"), F.max_by("event_id", F.struct("ts", "event_id")).alias("gauge"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )
    return rows


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and characters of each source, and a sum of digests of all its texts: nothing of a source meets in one task but sums."""
    part = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), "text").cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.sum(part).cast("string").alias("digest"))


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text put together again from its pages, in their order."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.text_pages(F.col("text"), 20)).alias("p")).select("doc_id", "p.page_number", "p.text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda s: s["text"])
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.md5(F.array_join(ordered, "\n").cast("binary")).alias("digest"))


def parents_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order: a child table with its parent's columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").filter("o_orderstatus <> 'P'")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is left once those of one priority are deleted, counted by flag."""
    left = S.delete(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), None, {"o_orderpriority": "1-URGENT"}, "l_orderkey")
    return S.cascade(left, table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with the count of all such, a nested count."""
    rows = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return rows.select("c_custkey", "c_name").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def unit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken in, then new texts of a third of them, each as one commit; what readers see of each document at the end."""
    store = Units(spark, shared_folder(spark))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    replace_documents(store, docs)
    replace_documents(store, docs.withColumn("text", F.when(F.col("document_id") % 3 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))))
    versions = store.read("versions").groupBy("unit").agg(F.count(F.lit(1)).alias("n_versions"), F.max("version").alias("last"))
    jobs = store.read("jobs").select("unit", F.col("version").alias("job_version"), "status")
    rows = store.read("documents").join(versions, "unit").join(jobs, "unit")
    return rows.select(F.col("unit").cast("long").alias("document_id"), "checksum", "n_versions", "last", "job_version", "status")


QUERIES = {
    "status_counts": status_counts,
    "index_stats": index_stats,
    "pagination": pagination,
    "latest_job": latest_job,
    "next_version": next_versions,
    "filter_builder": filters,
    "duplicate_checksums": duplicates,
    "vector_upsert": vector_upsert,
    "vector_delete": vector_delete,
    "vector_checks": vector_checks,
    "vector_repeats": repeated_vectors,
    "embedding_input_checks": input_checks,
    "embedding_cache": embedding_cache,
    "job_transitions": transitions,
    "job_state": job_state,
    "rate_limit": rate_limit,
    "rate_windows": rate_windows,
    "sessions": sessions,
    "metrics_by_tag": metrics_by_tag,
    "document_stats": document_stats,
    "full_text": full_text,
    "parent_join": parents_joined,
    "cascade_delete": cascade,
    "user_list": users,
    "unit_replace": unit_replace,
}

_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOB_STATUS.items()) + " END"
_ALLOWED = " OR ".join(f"(before = '{k}' AND status IN ({', '.join(repr(x) for x in v)}))" for k, v in S.TRANSITIONS.items() if v)

SQL = {
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "index_stats": """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
  round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1) AS progress,
  round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / greatest(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 1), 4) AS hit_rate FROM orders""",
    "pagination": """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, o_orderdate, (SELECT greatest(1, ceil(count(*) / 50.0))::BIGINT FROM o) AS pages
FROM (SELECT * FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50)""",
    "latest_job": """
SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
    "next_version": "SELECT l_orderkey, (max(l_linenumber) + 1)::INT AS next_version FROM lineitem GROUP BY 1",
    "filter_builder": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45') AND p_size >= 5 AND p_size < 40",
    "duplicate_checksums": """
SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents WHERE substr(source, 4, 2)::INT % 2 = 1
  AND text NOT IN (SELECT text FROM documents WHERE substr(source, 4, 2)::INT % 2 = 0) GROUP BY text""",
    "vector_upsert": """
WITH n AS (SELECT vec_id + 1 AS chunk_id, 99 AS label FROM embeddings WHERE label <= 3)
SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n""",
    "vector_delete": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE NOT (label >= 2 AND vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1))",
    "vector_checks": """
WITH e AS (SELECT vec_id % 7 AS k, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT CASE k WHEN 1 THEN v[1:10] WHEN 2 THEN list_append(v[1:63], 'nan'::DOUBLE) WHEN 3 THEN list_append(v[1:63], 'infinity'::DOUBLE) WHEN 4 THEN []::DOUBLE[] ELSE v END AS v FROM e)
SELECT CASE WHEN v IS NULL OR len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'dimension' WHEN len(list_filter(v, lambda x: isnan(x))) > 0 THEN 'nan'
  WHEN len(list_filter(v, lambda x: isinf(x))) > 0 THEN 'infinite' END AS error, count(*) AS n FROM b GROUP BY 1""",
    "vector_repeats": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings), t AS (SELECT * FROM v UNION ALL SELECT -1 - vec_id, v FROM v)
SELECT min(vec_id) AS first, count(*) AS n FROM t GROUP BY v HAVING count(*) > 1""",
    "embedding_input_checks": """
SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 2048 THEN 'too long' END AS error, count(*) AS n FROM documents GROUP BY 1""",
    "embedding_cache": """
WITH c AS (SELECT user_id, max(ts) AS last, max_by(event_id, (ts, event_id)) AS vector_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT event_id, vector_id FROM events e LEFT JOIN (SELECT * FROM c WHERE floor(epoch(last))::BIGINT > epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - 172800) c ON e.user_id = c.user_id WHERE event_type = 'purchase'""",
    "job_transitions": f"""
WITH j AS (SELECT event_id, user_id AS job_id, {_STATUS} AS status, lag({_STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, job_id, before, status, CASE WHEN before IS NULL THEN status = 'queued' ELSE {_ALLOWED} END AS allowed FROM j""",
    "job_state": f"""
WITH j AS (SELECT user_id AS job_id, max_by({_STATUS}, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS n FROM events GROUP BY 1)
SELECT job_id, status, failures, CASE WHEN failures % 4 + 1 < 3 THEN 'retrying' ELSE 'failed' END AS next, round(100.0::DOUBLE * done / n, 1) AS progress FROM j""",
    "rate_limit": """
WITH r AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id, n::INT AS n, 3600 - t % 3600 AS retry_after FROM r WHERE n > 1""",
    "rate_windows": "SELECT user_id, time_bucket(INTERVAL '60 seconds', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""",
    "metrics_by_tag": """
SELECT event_type, count(*) AS n, count(value) AS n_timed, max_by(event_id, (ts, event_id)) AS gauge, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1""",
    "document_stats": "SELECT source, count(*) AS n_chunks, sum(n_chars)::BIGINT AS n_chars, sum(('0x' || substr(md5(concat_ws('/', doc_id::VARCHAR, text)), 1, 12))::BIGINT)::VARCHAR AS digest FROM documents GROUP BY 1",
    "full_text": "SELECT doc_id, ((len(string_split(text, chr(10))) - 1) // 20 + 1)::BIGINT AS n_pages, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "parent_join": "SELECT o_custkey, o_orderstatus, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY 1",
    "user_list": "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING'",
    "unit_replace": """
SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 3 = 0 THEN concat(text, ' revised') ELSE text END) AS checksum, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_versions,
  CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS last, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS job_version, 'queued' AS status FROM documents""",
}
