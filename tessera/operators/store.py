"""Tables that are read and written: repositories, versions, caches, vector collections, jobs."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieve import predicate


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """Rows of a page (from 1) of the ordered table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def find_by(df: DataFrame, **equal: Any) -> DataFrame:
    return df.filter(predicate(equal, df.columns))


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The row of each key that is the last by some columns: an aggregate, no sort of whole groups."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row"))
    return newest.select(key, "row.*")


def next_version(versions: DataFrame, key: str = "document_id", number: str = "version_number") -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


def reject_duplicates(new: DataFrame, existing: DataFrame, content: str = "text", key: str | None = None) -> DataFrame:
    """New rows whose SHA-256 is not among the existing ones, each content once: the row of the least key (the first column, if not given)."""
    digest = lambda df: df.withColumn("checksum", F.sha2(F.col(content), 256))
    key = key or new.columns[0]
    rows = digest(new)
    once = rows.groupBy("checksum").agg(F.min_by(F.struct(*new.columns), F.struct(key, *new.columns)).alias("row")).select("row.*", "checksum")
    return once.join(digest(existing).select("checksum"), "checksum", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """New rows replace those of their key; of several new ones of a key the last by some columns (all, if not given) counts."""
    once = latest(new, key, by or [c for c in new.columns if c != key])
    return existing.join(once.select(key), key, "left_anti").unionByName(once)


def delete(existing: DataFrame, ids: DataFrame | None = None, filters: dict[str, Any] | None = None, key: str = "chunk_id") -> DataFrame:
    """What is left without the rows of some keys that also match the filters; one of both must be given."""
    if ids is None and not filters:
        raise ValueError("ids or filters are needed")
    gone = existing.filter(predicate(filters or {}, existing.columns))
    gone = gone if ids is None else gone.join(ids.select(key), key, "left_semi")
    return existing.join(gone.select(key), key, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(key), key, "left_semi")


CACHE_KEY = ["checksum", "model", "dimension"]


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, ttl: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """Hits with their vectors, and misses; an entry lives `ttl` seconds from its last access."""
    alive = cache.filter(F.unix_timestamp("last_access") > F.unix_timestamp(now) - ttl)
    return wanted.join(alive, CACHE_KEY), wanted.join(alive.select(*CACHE_KEY), CACHE_KEY, "left_anti")


def cache_invalidate(cache: DataFrame, model: str | None = None, checksums: DataFrame | None = None) -> DataFrame:
    """The cache without the entries of a model, of some contents, or of these contents in that model; without either it is emptied."""
    gone = cache if model is None else cache.filter(F.col("model") == model)
    gone = gone if checksums is None else gone.join(checksums.select("checksum"), "checksum", "left_semi")
    return cache.join(gone.select(*CACHE_KEY), CACHE_KEY, "left_anti")


def cache_refresh(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Entries that were hit start their time anew."""
    touched = hits.select(*CACHE_KEY).distinct().withColumn("_now", now)
    return cache.join(touched, CACHE_KEY, "left").withColumn("last_access", F.coalesce("_now", "last_access")).drop("_now")


def vector_errors(vector: Column, dimension: int) -> Column:
    """empty, dimension, nan or infinite; null if the vector is sound."""
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(F.size(vector) != dimension, "dimension")
        .when(F.exists(vector, lambda x: F.isnan(x)), "nan")
        .when(F.exists(vector, lambda x: F.abs(x) == F.lit(float("inf"))), "infinite")
    )


def repeated_vectors(vectors: DataFrame, places: int = 6) -> DataFrame:
    """Groups of vectors that are equal when rounded."""
    rounded = F.transform("vector", lambda x: F.round(x.cast("double"), places))
    return vectors.groupBy(rounded.alias("rounded")).agg(F.min("chunk_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", "n")


def text_errors(text: Column, longest: int = 2048) -> Column:
    return F.when(text.isNull() | (F.trim(text) == ""), "blank").when(F.length(text) > longest, "too long")


class Collections:
    """Vector collections as tables named {prefix}{base}_v{dimension}_v{n} in Spark's catalog."""

    def __init__(self, spark: SparkSession, prefix: str = "rag_"):
        self.spark, self.prefix = spark, prefix

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix) and not t.isTemporary)

    def versions(self, base: str, dimension: int) -> list[int]:
        name = re.compile(re.escape(f"{self.prefix}{base}_v{dimension}_v".lower()) + r"(\d+)")
        return sorted(int(m[1]) for t in self.names() if (m := name.fullmatch(t)))

    def create(self, base: str, dimension: int, rows: DataFrame) -> str:
        """A next version that holds the rows."""
        name = f"{self.prefix}{base}_v{dimension}_v{max(self.versions(base, dimension), default=0) + 1}"
        rows.write.mode("errorifexists").saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def migrate(self, source: str, target: str) -> None:
        """Add to one collection the rows of another whose keys it lacks."""
        rows = self.read(source).join(self.read(target).select("chunk_id"), "chunk_id", "left_anti")
        rows.select(*self.read(target).columns).write.insertInto(target)

    def drop(self, name: str, force: bool = False) -> None:
        if re.search(r"_v\d+_v\d+$", name) and not force:
            raise ValueError(f"{name} is a version of a collection; force drops it")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")


# What a job's status may become (fixed values)
TRANSITIONS = {
    "queued": ("processing", "cancelled"),
    "processing": ("embedding", "writing", "completed", "failed", "cancelled"),
    "embedding": ("writing", "completed", "failed", "cancelled"),
    "writing": ("completed", "failed", "cancelled"),
    "failed": ("retrying", "cancelled"),
    "retrying": ("processing", "failed", "cancelled"),
    "completed": (),
    "cancelled": (),
}


def allowed(before: Column, after: Column) -> Column:
    """Whether a job may pass from one status to the other; the first must be queued."""
    ok = F.lit(False)
    for status, following in TRANSITIONS.items():
        if following:
            ok = ok | ((before == status) & after.isin(*following))
    return F.when(before.isNull(), after == "queued").otherwise(ok)


def judged_transitions(events: DataFrame) -> DataFrame:
    """Each status event (job_id, status, ts, event_id) with the one before and whether it was allowed."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = events.withColumn("before", F.lag("status").over(w))
    return rows.withColumn("allowed", allowed(F.col("before"), F.col("status")))


def after_failure(retries: Column, most: Column) -> Column:
    return F.when(retries + 1 < most, "retrying").otherwise("failed")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * done / total, 1)).otherwise(0.0)


# Stages of an ingestion job and how far each is (fixed values)
STAGES = {"extracting": 10, "ocr_check": 25, "cleaning": 40, "detecting_language": 50, "chunking": 60, "storing": 75, "completed": 100}


def stage_progress(events: DataFrame) -> DataFrame:
    """(job_id, stage, progress): where each job is, by its last stage event (job_id, stage, ts, event_id); unknown stages do not count."""
    table = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    known = events.withColumn("progress", table[F.col("stage")]).filter("progress IS NOT NULL")
    return known.groupBy("job_id").agg(F.max_by(F.struct("stage", "progress"), F.struct("ts", "event_id")).alias("last")).select("job_id", "last.*")


def transition(jobs: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The jobs (job_id, status, ...) with those of some ids in a new status where that is allowed, and a column `refused` for the others of them."""
    asked = ids.select("job_id").distinct().withColumn("_asked", F.lit(True))
    may = allowed(F.col("status"), F.lit(status))
    rows = jobs.join(asked, "job_id", "left")
    wanted = F.coalesce("_asked", F.lit(False))
    return rows.withColumn("refused", wanted & ~F.coalesce(may, F.lit(False))).withColumn("status", F.when(wanted & may, status).otherwise(F.col("status"))).drop("_asked")


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(jobs, ids, "cancelled")


def reset_for_retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Retrying jobs of some ids are queued again, without what is left of the last try; others of them are refused."""
    asked = ids.select("job_id").distinct().withColumn("_asked", F.lit(True))
    rows = jobs.join(asked, "job_id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    again = F.col("_asked") & (F.col("status") == "retrying")
    out = rows.withColumn("refused", F.col("_asked") & ~again)
    for c in ("checkpoint", "error_message", "error_details", "started_at"):
        if c in jobs.columns:
            out = out.withColumn(c, F.when(~again, F.col(c)))
    return out.withColumn("status", F.when(again, "queued").otherwise(F.col("status"))).drop("_asked")


def vector_records(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Records for a collection: chunks with their vectors (chunk_id, vector) and defaults for what a chunk lacks; chunks without a vector have none."""
    held = set(chunks.columns)
    or_else = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in held else F.lit(default)).cast(kind).alias(c)
    maybe = lambda c, kind: (F.col(c) if c in held else F.lit(None)).cast(kind).alias(c)
    rows = chunks.join(vectors.filter("vector IS NOT NULL").select("chunk_id", "vector"), "chunk_id")
    return rows.select(
        "chunk_id", or_else("document_id", "string", ""), "vector", or_else("text", "string", ""), maybe("page_number", "int"), or_else("chunk_index", "int", 0), maybe("section_title", "string"),
        or_else("language", "string", "unknown"), or_else("checksum", "string", ""), or_else("version", "int", 1), or_else("source", "string", ""), F.lit(model).alias("embedding_model"),
    )


def get_vector(vectors: DataFrame, chunk_id: Any) -> DataFrame:
    """The record of a key: one row or none."""
    return vectors.filter(F.col("chunk_id") == F.lit(chunk_id)).limit(1)


def reindexed(index: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """The index with all rows of the given chunks' documents replaced by these chunks."""
    return index.join(chunks.select(key).distinct(), key, "left_anti").unionByName(chunks)


def changed(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose content the index does not have yet, by checksum."""
    return chunks.join(index.select("checksum"), "checksum", "left_anti")


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """The rows with deleted_at set where a key is among the ids; those that were deleted before keep their time."""
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), now))).drop("_gone")


def active(rows: DataFrame) -> DataFrame:
    return rows.filter("deleted_at IS NULL")


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[Column], number: int, size: int) -> DataFrame:
    """A page (from 1) of the child rows of each parent, in order, with their place and how many there are."""
    held = rows.join(parents.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key)
    placed = held.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    return placed.filter((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size))


def create(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The existing rows and the new ones; a key that is there already, repeats or is null is an error."""
    wrong = new.groupBy(key).count().filter(f"`{key}` IS NULL OR count > 1").select(key).unionByName(new.join(existing.select(key), key, "left_semi").select(key)).limit(1).collect()
    if wrong:
        raise ValueError(f"{key} {wrong[0][0]} is there already, repeats or is null")
    return existing.unionByName(new)


def update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The existing rows with the other columns of changes, where these are not null; keys that do not exist change nothing."""
    columns = [c for c in changes.columns if c != key]
    given = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return existing.join(given, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns))


def exist(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ids with whether there is a row of each."""
    return ids.join(rows.select(key).distinct().withColumn("exists", F.lit(True)), key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
