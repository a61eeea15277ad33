"""An inverted file of vectors: lists around centroids, kept as partitions, read as far as a bound asks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import saved
from tessera.operators.products import Best, by_length, held_queries, kinds, unit_rows
from tessera.operators.retrieve import MOST_NUMBERS, directed, predicate, top

#: Vectors that the centroids are fitted on, at most: so many a list, those of the least hash of their id.
SAMPLE_A_LIST, MOST_SAMPLE = 40, 100_000
#: Lists are about as many as the square root of the vectors, within these bounds.
LEAST_LISTS, MOST_LISTS = 8, 2048
#: Of angles that are rounded, in radians.
SLACK = 2e-6


def fit_centroids(vectors: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample; every vector is indexed by what comes of it."""
    most = min(MOST_SAMPLE, SAMPLE_A_LIST * lists)
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("vector").toArrow().column("vector")
    sample = unit_rows(next(by_length(rows))[1])
    # far apart: each next one is the vector that is least like those before
    centroids, near = [sample[0]], sample @ sample[0]
    while len(centroids) < min(lists, len(sample)):
        centroids.append(sample[near.argmin()])
        near = np.maximum(near, sample @ centroids[-1])
    centroids = np.array(centroids)
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids


class VectorIndex:
    """Vectors (chunk_id, vector, further columns) in lists, a partition each, with how far each list reaches from its centroid.

    All vectors must have one length; those without a direction are not indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int | None = None) -> None:
        """Index the vectors; what was there before is replaced."""
        vectors = vectors.filter(directed(F.col("vector")))
        n, least, most = vectors.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if least != most:
            raise ValueError(f"vectors of {least} to {most} components: an index holds one length")
        if not n:
            raise ValueError("there are no vectors to index")
        lists = lists or min(MOST_LISTS, max(LEAST_LISTS, math.isqrt(n)))
        centroids = fit_centroids(vectors, lists)
        shared = self.spark.sparkContext.broadcast(centroids)
        rest = [c for c in vectors.columns if c != "vector"]
        schema = vectors.select(*rest).withColumns({"vector": F.lit(None).cast("array<double>"), "list": F.lit(0), "angle": F.lit(0.0)}).schema

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, rows in by_length(batch.column("vector")) if batch.num_rows else ():
                    rows = unit_rows(rows)
                    like = rows @ shared.value.T
                    nearest = like.argmax(axis=1)
                    angle = np.arccos(np.clip(like[np.arange(len(rows)), nearest], -1, 1))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                    columns = [batch.column(c).take(pa.array(at)) for c in rest] + [flat, pa.array(nearest.astype(np.int32)), pa.array(angle)]
                    yield pa.RecordBatch.from_arrays(columns, [*rest, "vector", "list", "angle"])

        placed = vectors.select(*rest, "vector").mapInArrow(assign, schema)
        # a list may hold any share of all: it is dealt to several tasks and files
        dealt = placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // (lists * 50_000)) if n > lists * 50_000 else 1)))
        dealt.write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/lists")
        reach = self.spark.read.parquet(f"{self.path}/lists").groupBy("list").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n"))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        table.join(reach, "list").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def search(self, queries: DataFrame, k: int = 10, filters: dict[str, Any] | None = None, probes: int | None = None) -> DataFrame:
        return self.look(queries, k, filters, probes)[0]

    def look(self, queries: DataFrame, k: int = 10, filters: dict[str, Any] | None = None, probes: int | None = None) -> tuple[DataFrame, list[dict]]:
        """(query_id, chunk_id, score, rank) by cosine, and of each query how many vectors were compared (query_id, read, of).

        Each query first reads the lists nearest to it, until they hold twice k
        vectors. What its k-th best of these reaches, it then asks of all other
        lists: by the triangle inequality of angles, no vector of a list is
        nearer than the centroid less the list's reach. Lists beyond are not
        read, and the hits are exact. `probes` reads so many nearest lists
        instead, and nothing else: faster, with a recall to be measured.
        Filters are applied to the lists' rows before they are compared.
        Queries without direction or of another length have no hits.
        """
        queries = queries.filter(F.col("query_id").isNotNull() & directed(F.col("vector")))
        lists = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r["list"])
        centroids, reach = np.array([r["centroid"] for r in lists]), np.array([r["angle"] for r in lists])
        names, sizes = np.array([r["list"] for r in lists]), np.array([r["n"] for r in lists])
        dim = centroids.shape[1]
        index = self.spark.read.parquet(f"{self.path}/lists")
        index = index.filter(predicate(filters or {}, index.columns))
        queries = queries.filter(F.size("vector") == dim)
        n = queries.count()
        # a stated set, in blocks of bounded size
        out, told, blocks = None, [], max(1, -(-n * dim // MOST_NUMBERS))
        numbered = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        for block in range(blocks):
            held = held_queries(numbered.filter(F.col("block") == block)).get(dim)
            if held is None:
                continue
            ids, them = held
            angle = np.arccos(np.clip(them @ centroids.T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")
            if probes:
                first = np.zeros(angle.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
            else:
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                first = np.zeros(angle.shape, bool)
                np.put_along_axis(first, order, before < 2 * k, axis=1)
            hits = saved(top(self._compared(index, names, ids, them, first, k, queries), k))
            read = first
            if not probes:
                last = {r["query_id"]: r["score"] for r in hits.filter(F.col("rank") == k).collect()}
                far = np.array([np.arccos(min(1.0, last[i])) if i in last else np.pi for i in ids.to_pylist()])
                # a score is rounded to six places, which is more in angles near zero
                far = np.arccos(np.clip(np.cos(far) - SLACK, -1, 1))
                more = ~first & (angle - reach[None, :] <= far[:, None] + SLACK)
                hits = top(hits.drop("rank").unionByName(self._compared(index, names, ids, them, more, k, queries)), k)
                read = first | more
            told += [{"query_id": i, "read": int(sizes[r].sum()), "of": int(sizes.sum())} for i, r in zip(ids.to_pylist(), read, strict=True)]
            out = hits if out is None else out.unionByName(hits)
        if out is None:
            query_kind, chunk_kind = kinds(index, queries)
            out = self.spark.createDataFrame([], f"query_id {query_kind}, chunk_id {chunk_kind}, score double, rank int")
        return out.select("query_id", "chunk_id", "score", "rank"), told

    def _compared(self, index: DataFrame, names: np.ndarray, ids: pa.Array, them: np.ndarray, probed: np.ndarray, k: int, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of the vectors in each query's lists; only these partitions are read."""
        used = names[probed.any(axis=0)]
        shared = self.spark.sparkContext.broadcast((ids, them, {int(x): np.flatnonzero(probed[:, i]) for i, x in enumerate(names)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, them, asking = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("list").to_numpy()
                for x in np.unique(lists):
                    at, who = np.flatnonzero(lists == x), asking[int(x)]
                    if not len(who):
                        continue
                    _, rows = next(by_length(batch.column("vector").take(pa.array(at))))
                    best = Best(them[who], k)
                    best.feed(rows, batch.column("chunk_id").take(pa.array(at)))
                    yield from best.found(ids.take(pa.array(who)))

        found = index.filter(F.col("list").isin(*map(int, used))) if len(used) else index.limit(0)
        out = found.select("chunk_id", "vector", "list").mapInArrow(run, "query_id {}, chunk_id {}, score double".format(*kinds(index, queries)))
        return out.withColumn("score", F.round("score", 6))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact hits that were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return hits.agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
