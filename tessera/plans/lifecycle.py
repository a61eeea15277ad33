"""Jobs, records, repositories, names, word fixes and contexts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean, tokens
from tessera.operators import context as C
from tessera.operators import store as S
from tessera.plans.common import chunks, table
from tessera.plans.contexts import _HITS, _hits

# What the tables' codes stand for here
STAGE_OF = {"signup": "extracting", "view": "cleaning", "click": "chunking", "purchase": "completed", "error": "unknown"}
STATUS_OF = {"1-URGENT": "queued", "2-HIGH": "processing", "3-MEDIUM": "failed", "4-NOT SPECIFIED": "retrying", "5-LOW": "completed"}


def _map(names: dict[str, str], c: str):
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col(c)]


def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of their user's job."""
    return S.stage_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), _map(STAGE_OF, "event_type").alias("stage"), "ts", "event_id"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), _map(STATUS_OF, "o_orderpriority").alias("status"), F.col("o_clerk" if "o_clerk" in orders.columns else "o_orderstatus").alias("error_message"))
    return jobs, orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job_id"))


def cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cancel(*_jobs(spark, sf_dir)).groupBy("status", "refused").agg(F.count(F.lit(1)).alias("n"), F.sum("job_id").alias("ids"))


def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reset_for_retry(*_jobs(spark, sf_dir)).groupBy("status", "refused").agg(F.count(F.lit(1)).alias("n"), F.count("error_message").alias("n_errors"))


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of some documents (sources) are replaced by the longer ones of these."""
    rows = chunks(spark, sf_dir).select("chunk_id", "document_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    new = chunks(spark, sf_dir).filter("document_id IN ('src0', 'src2') AND length(text) > 1000").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "document_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return S.reindexed(rows, new).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"), F.count_if(F.col("chunk_id") >= 1_000_000).alias("n_new"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose content an index of every second document lacks."""
    rows = chunks(spark, sf_dir).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("checksum"))
    return S.changed(rows, rows.filter("chunk_id % 2 = 0"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    found = S.vector_records(chunks(spark, sf_dir), vectors, "hash")
    return found.select("chunk_id", "document_id", F.size("vector").alias("dimension"), F.length("text").alias("n_chars"), "page_number", "chunk_index", "language", "version", "source", "embedding_model")


def one_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    last = vectors.agg(F.max("chunk_id")).first()[0]
    return S.get_vector(vectors, last).select("chunk_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", tokens.language_name(F.col("lang")).alias("name"), tokens.is_supported(F.col("lang")).alias("supported")).agg(F.count(F.lit(1)).alias("n"))


def word_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Rll Hl 1 apple "), "text", F.lit(" corner II 1 A barn"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.ocr_words(text).cast("binary")).alias("digest"))


def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that were deleted at some time, and those of some customers that go now."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.lit("2024-01-01")).alias("deleted_at"))
    ids = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select("o_orderkey")
    out = S.soft_delete(rows, ids, "o_orderkey", F.lit("2024-02-02"))
    return out.groupBy("deleted_at").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ids")).withColumn("n_active", F.lit(S.active(out).count()))


def child_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of three lines of each urgent order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "price")]
    return S.children(orders, lines, "l_orderkey", order, 2, 3).select("l_orderkey", "place", "total", "l_linenumber", "l_partkey")


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which some are new and some change, and whether some keys exist."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    both = S.create(rows, rows.filter("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000), "c_custkey")
    changes = rows.filter("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, F.lit("NEW")).alias("c_mktsegment"))
    asked = rows.select((F.col("c_custkey") * 2).alias("c_custkey"))
    return S.update(both, changes, "c_custkey").join(S.exist(both, asked, "c_custkey"), "c_custkey", "left").groupBy("c_mktsegment", "exists").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("ids"))


def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the context of a window of 512 tokens, beside a system text and an answer."""
    n = lambda size: F.floor(F.length("text") / size).cast("int")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", C.usage(F.lit(512), n(4), n(16), F.lit(64)).alias("u"), C.fits(F.col("text"), F.lit(256)).alias("fits"), C.remaining(F.col("text"), F.lit(256)).alias("left_over"))
    return rows.select("doc_id", "u.*", "fits", "left_over")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with titles, sections, pages and rerank scores that some of them lack."""
    id_ = F.col("chunk_id")
    return _hits(spark, sf_dir).select(
        "query_id", "chunk_id", "document_id", "chunk_index", "text", "score", F.when(id_ % 2 == 0, F.concat(F.lit("Title "), id_.cast("string"))).when(id_ % 3 == 0, "").alias("title"),
        F.when(id_ % 3 == 1, "Part").alias("section"), F.when(id_ % 4 > 0, (id_ % 4).cast("int")).alias("page"), F.when(id_ % 5 > 0, "bm25_reranked").alias("source"), F.when(id_ % 7 > 0, F.col("score") / 10).alias("rerank"),
    )


def managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.build_context(_described(spark, sf_dir), 800)
    return out.select("query_id", "n_sources", "n_tokens", F.md5(F.col("context").cast("binary")).alias("digest"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with its hits as references, merged into an answer and for a further prompt."""
    cited = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("index"), "title", "section", "page", F.substring("text", 1, 300).alias("preview"))))
    ranked = _described(spark, sf_dir).join(_hits(spark, sf_dir).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])
    rows = ranked.groupBy("query_id").agg(cited.alias("c"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("query_id", md5(F.concat(F.lit("answer"), C.references(F.col("c")))).alias("answer"), md5(C.referenced(F.col("c"))).alias("prompt"))


QUERIES = {
    "job_stage_progress": stage_progress,
    "jobs_cancelled": cancelled,
    "jobs_reset": reset,
    "index_reindexed": reindexed,
    "index_changed": changed,
    "vector_records": records,
    "vector_get": one_vector,
    "language_names": names,
    "clean_ocr_words": word_fixes,
    "soft_delete": soft_deleted,
    "child_pages": child_pages,
    "repository_changes": repository,
    "budget_usage": budget_usage,
    "context_managed": managed,
    "citation_references": references,
}


def _case(names: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_JOBS = f"""
j AS (SELECT o_orderkey AS job_id, {_case(STATUS_OF, "o_orderpriority")} AS status, o_orderstatus <> 'P' AS asked FROM orders)"""
_TOK = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
_HEAD = """concat_ws(' | ', '[Source ' || {0} || ']', coalesce(nullif(title, ''), 'Document ' || substr(document_id, 1, 8)), '§ ' || section, 'p.' || page, '[' || replace(source, '_reranked', '✓') || ']',
  coalesce('rerank:' || printf('%.3f', rerank), 'score:' || printf('%.3f', score)))"""
_DESCRIBED = """
described AS (SELECT query_id, chunk_id, document_id, chunk_index, text, score, rank, CASE WHEN chunk_id % 2 = 0 THEN concat('Title ', chunk_id) WHEN chunk_id % 3 = 0 THEN '' END AS title, CASE WHEN chunk_id % 3 = 1 THEN 'Part' END AS section,
  CASE WHEN chunk_id % 4 > 0 THEN chunk_id % 4 END AS page, CASE WHEN chunk_id % 5 > 0 THEN 'bm25_reranked' END AS source, CASE WHEN chunk_id % 7 > 0 THEN score / 10 END AS rerank FROM hits)"""
SQL = {
    "job_stage_progress": f"""
WITH e AS (SELECT user_id AS job_id, {_case(STAGE_OF, "event_type")} AS stage, ts, event_id FROM events WHERE event_type <> 'error')
SELECT job_id, max_by(stage, (ts, event_id)) AS stage, CASE max_by(stage, (ts, event_id)) WHEN 'extracting' THEN 10 WHEN 'cleaning' THEN 40 WHEN 'chunking' THEN 60 ELSE 100 END AS progress FROM e GROUP BY job_id""",
    "jobs_cancelled": f"""
WITH {_JOBS}, k AS (SELECT *, status <> 'completed' AS may FROM j)
SELECT CASE WHEN asked AND may THEN 'cancelled' ELSE status END AS status, asked AND NOT may AS refused, count(*) AS n, sum(job_id)::BIGINT AS ids FROM k GROUP BY 1, 2""",
    "jobs_reset": f"""
WITH {_JOBS} SELECT CASE WHEN asked AND status = 'retrying' THEN 'queued' ELSE status END AS status, asked AND status <> 'retrying' AS refused, count(*) AS n, count(*) FILTER (WHERE NOT (asked AND status = 'retrying')) AS n_errors FROM j GROUP BY 1, 2""",
    "index_reindexed": """
WITH n AS (SELECT doc_id + 1000000 AS chunk_id, source FROM documents WHERE source IN ('src0', 'src2') AND length(text) > 1000),
r AS (SELECT doc_id AS chunk_id, source FROM documents WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT * FROM n)
SELECT source AS document_id, count(*) AS n, sum(chunk_id)::BIGINT AS ids, count(*) FILTER (WHERE chunk_id >= 1000000) AS n_new FROM r GROUP BY source""",
    "index_changed": "SELECT doc_id AS chunk_id, md5(text) AS checksum FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)",
    "vector_records": """
SELECT doc_id AS chunk_id, d.source AS document_id, len(embedding)::INT AS dimension, length(text)::INT AS n_chars, NULL::INT AS page_number, doc_id::INT AS chunk_index, lang AS language, 1 AS version, '' AS source, 'hash' AS embedding_model
FROM documents d JOIN embeddings ON doc_id = vec_id WHERE embedding IS NOT NULL""",
    "vector_get": "SELECT vec_id AS chunk_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)",
    "language_names": f"SELECT lang, {_case({k: tokens.LANGUAGES[k] for k in ('en', 'fr', 'de', 'es')}, 'lang')} AS name, true AS supported, count(*) AS n FROM documents GROUP BY lang",
    "clean_ocr_words": r"""
WITH t AS (SELECT doc_id, concat('Rll Hl 1 apple ', text, ' corner II 1 A barn') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\bRll\b', 'All', 'g'), '\bHl\b', 'Hi', 'g'), '\b1\b(\s+[a-z])', 'I\1', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\w)rn(\w)', '\1m\2', 'g'), '(\w)rn(\w)', '\1m\2', 'g') AS t FROM a)
SELECT doc_id, md5(regexp_replace(t, '\bII\b', 'll', 'g')) AS digest FROM b""",
    "soft_delete": """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '2024-01-01' WHEN o_custkey % 3 = 0 THEN '2024-02-02' END AS deleted_at FROM orders)
SELECT deleted_at, count(*) AS n, sum(o_orderkey)::BIGINT AS ids, (SELECT count(*) FROM d WHERE deleted_at IS NULL)::INT AS n_active FROM d GROUP BY deleted_at""",
    "child_pages": """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS place, count(*) OVER (PARTITION BY l_orderkey) AS total, l_linenumber, l_partkey
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT * FROM l WHERE place BETWEEN 4 AND 6""",
    "repository_changes": """
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, c_mktsegment FROM customer WHERE c_custkey % 5 = 0),
x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT c_custkey * 2 FROM customer) THEN true END AS exists FROM b)
SELECT c_mktsegment, exists, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM x GROUP BY 1, 2""",
    "budget_usage": f"""
WITH d AS (SELECT doc_id, length(text) // 4 + length(text) // 16 + 64 AS total, {_TOK.format("text")} AS tokens FROM documents WHERE text IS NOT NULL)
SELECT doc_id, total::INT AS total, round(total / 512 * 100, 1) AS percent, greatest(512 - total, 0)::INT AS remaining, total <= 512 AS within, tokens <= 256 AS fits, greatest(256 - tokens, 0)::INT AS left_over FROM d""",
    "context_managed": f"""
WITH {_HITS}, {_DESCRIBED},
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM described),
t AS (SELECT *, {_HEAD.format("place")} || chr(10) || trim(text, ' ') || chr(10) AS block FROM p),
u AS (SELECT *, {_TOK.format("block")} AS tokens, sum({_TOK.format("block")}) OVER (PARTITION BY query_id ORDER BY place) AS used FROM t),
k AS (SELECT * REPLACE (CASE WHEN used > 800 AND {_TOK.format("text")} > 750 THEN substr(text, 1, floor(length(text) * 750 / ({_TOK.format("text")}))::INT) || chr(10) || '[Content truncated]' ELSE text END AS text) FROM u WHERE used <= 800 OR place = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS number FROM k)
SELECT query_id, count(*) AS n_sources, coalesce(sum(tokens) FILTER (WHERE used <= 800), 0)::BIGINT AS n_tokens, md5(string_agg({_HEAD.format("number")} || chr(10) || trim(text, ' ') || chr(10), chr(10) ORDER BY number)) AS digest FROM n GROUP BY query_id""",
    "citation_references": f"""
WITH {_HITS}, {_DESCRIBED},
l AS (SELECT *, concat_ws(' | ', '[' || rank || ']', nullif(title, ''), 'Section: ' || section, 'Page ' || page) AS ref, concat_ws(', ', 'p. ' || page, section) AS place FROM described)
SELECT query_id, md5(concat('answer', chr(10), chr(10), '## References', chr(10), string_agg(ref, chr(10) ORDER BY rank))) AS answer,
  md5(concat('## Referenced Sources', chr(10), string_agg(concat('[', rank, '] ', coalesce(title, ''), CASE WHEN place <> '' THEN concat(' (', place, ')') ELSE '' END, ': \"\"\"', substr(text, 1, 300), '\"\"\"'), chr(10) ORDER BY rank))) AS prompt FROM l GROUP BY query_id""",
}
