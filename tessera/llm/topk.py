"""Exact top-k inner products over vectors in order of length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: The rotation is fitted on so many vectors at most; it changes the speed only, never the result.
SAMPLE = 4096
#: So many of the longest vectors give each query a first bound; they change the speed only, too.
SEEDS = 2048
#: Whole numbers up to here are exact as doubles, and in sums of 64-bit numbers up to there.
EXACT_DOUBLE, EXACT_LONG = 2.0**52, 2.0**62


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, those of the largest singular values first."""
    if not len(sample):
        return np.eye(sample.shape[1])
    scaled = sample / max(1.0, np.abs(sample).max())
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1].copy()


def largest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors.astype(np.float64)).max(initial=0))


class Search:
    """The running k best of a block of queries, fed with vectors in descending order of length.

    Rows of one id are one query, whose score with an id is the highest of
    their rows; `least` holds what each query's k-th best is known to reach.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, basis: np.ndarray, k: int, lead: int):
        self.vectors, self.k, self.lead, self.basis = vectors, k, lead, basis
        self.names, self.of = np.unique(ids, return_inverse=True)
        self.double = vectors.astype(np.float64)
        turned = self.double @ basis
        self.head, self.rest = turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)
        self.length = np.linalg.norm(self.double, axis=1)
        self.least = np.full(len(self.names), -np.inf)
        np.maximum.at(self.least, self.of, least)
        #: (query's place, id, score): numbers of 64 bits, or of any size.
        self.q, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        double = vectors.astype(np.float64)
        length = np.linalg.norm(double, axis=1)
        longest = length.max(initial=0)
        # of the rounded bounds, and of a score that is rounded to a double itself
        slack = 1e-9 * (1 + self.length * longest)
        # Cauchy-Schwarz on whole vectors: a query that even the longest cannot serve is done with all that follow
        open_ = np.flatnonzero(self.length * longest + slack >= self.least[self.of])
        if not len(open_) or not len(ids):
            return
        turned = double @ self.basis
        head, rest = turned[:, : self.lead], np.linalg.norm(turned[:, self.lead :], axis=1)
        # partial sums, and Cauchy-Schwarz on the residuals
        bound = self.head[open_] @ head.T
        bound += np.outer(self.rest[open_], rest)
        reach = bound >= (self.least[self.of[open_]] - slack[open_])[:, None]
        most = largest(self.vectors) * largest(vectors) * max(1, vectors.shape[1])
        if most < EXACT_DOUBLE and np.count_nonzero(reach) * 16 > reach.size:
            # many are left: all products at once are exact, too
            products = self.double[open_] @ double.T
            reach &= products >= self.least[self.of[open_]][:, None]
            q, c = np.nonzero(reach)
            scores = np.rint(products[q, c]).astype(np.int64)
            q = open_[q]
        else:
            q, c = np.nonzero(reach)
            q = open_[q]
            parts = [np.zeros(0, np.int64)]
            for i in range(0, len(q), 65_536):
                at = slice(i, i + 65_536)
                if most < EXACT_LONG:
                    parts.append(np.einsum("ij,ij->i", self.vectors[q[at]].astype(np.int64), vectors[c[at]].astype(np.int64)))
                else:
                    parts.append((self.vectors[q[at]].astype(object) * vectors[c[at]].astype(object)).sum(axis=1))
            scores = np.concatenate(parts)
        of, held = self.of[q], ids[c]
        keep = (self.names[of] != held) & (scores.astype(np.float64) >= self.least[of])
        self._add(of[keep], held[keep], scores[keep])

    def _add(self, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        if not len(q):
            return
        q, c, s = np.concatenate([self.q, q]), np.concatenate([self.c, c]), np.concatenate([self.s, s])
        if s.dtype == object:
            # numbers beyond 64 bits are put in order by their place among all
            place = np.searchsorted(np.array(sorted(set(s.tolist())), object), s)
        else:
            place = s
        order = np.lexsort((-place, c, q))
        q, c, s, place = q[order], c[order], s[order], place[order]
        # an id counts once
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s, place = q[fresh], c[fresh], s[fresh], place[fresh]
        order = np.lexsort((c, -place, q))
        q, c, s = q[order], c[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        best = nth < self.k
        self.q, self.c, self.s = q[best], c[best], s[best]
        last = np.flatnonzero(nth == self.k - 1)
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last].astype(np.float64))

    def found(self) -> pa.RecordBatch:
        if self.s.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in self.s):
            raise OverflowError("an inner product among the k best leaves 64 bits: use a smaller scale")
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.q]), pa.array(self.c), pa.array(self.s.astype(np.int64))], ["query_id", "vec_id", "score"])


def first_bounds(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each query what its k-th best reaches at least: its k-th product with some vectors of other ids, each id once."""
    names, first = np.unique(seed_ids, return_index=True)
    if len(names) <= k:
        return np.full(len(ids), -np.inf)
    products = vectors.astype(np.float64) @ seeds[first].astype(np.float64).T
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    own = np.flatnonzero(names[at] == ids)
    products[own, at[own]] = -np.inf
    low = np.partition(products, -k, axis=1)[:, -k]
    # the products are rounded
    return low - 1e-9 * (1 + np.linalg.norm(vectors.astype(np.float64), axis=1) * np.linalg.norm(seeds.astype(np.float64), axis=1).max())


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null unless all are finite. A component that leaves 64 bits is an error."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    scaled = F.transform(doubles, lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component times the scale leaves 64 bits")).cast("long")))
    return F.when(F.forall(doubles, finite), scaled)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, lead: int = 16, query_block: int = 4096, chunk: int = 2048
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to the smaller vec_id.

    `vectors` has vec_id and v, an array of integers; rows where is_query holds
    are queries against all rows of another vec_id. Vectors are dealt into
    lanes by a hash of vec_id and sorted by length within each; blocks of
    queries meet all lanes. The SEEDS longest vectors of all give each query a
    bound that holds in every lane from the start; in each lane a block keeps
    its k best so far. A vector is skipped where |q||c| is below a query's k-th
    best, or where the partial product over the `lead` largest principal
    directions plus the product of the residuals' lengths is; all others are
    scored exactly, in 64 bits or, where these may not do, in whole numbers of
    any size. A score among the k best that leaves 64 bits is an error.

    Rows with null vec_id or v take no part. Shorter vectors count as filled up
    with zeros. Rows of one vec_id are one candidate and one query: the score of
    two ids is the highest of their rows. An empty table gives no rows; further
    columns are ignored.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = cut(vectors.select(F.col("vec_id").cast("long"), "v", F.coalesce(is_query, F.lit(False)).alias("asks")).filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("square", square))
    dim, asking = rows.agg(F.max(F.size("v")), F.count_if("asks")).first()
    dim = max(dim or 1, 1)
    blocks, lanes = max(1, -(-(asking or 0) // query_block)), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), dim), np.int64)
        counts = np.diff(column.offsets.to_numpy())
        at = np.repeat(np.arange(len(column)), counts)
        out[at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    basis = rotation((matrix(sample) if len(sample) else np.zeros((0, dim))).astype(np.float64))
    longest = rows.orderBy(F.desc("square"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow().combine_chunks()
    seed_ids, seeds = longest.column("vec_id").to_numpy(), matrix(longest.column("v").combine_chunks()) if len(longest) else np.zeros((0, dim), np.int64)
    shared = spark.sparkContext.broadcast((basis, seed_ids, seeds))

    packed = "lane int, block int, kind int, seq long, ids binary, vectors binary, least binary"

    def pack(of: str, kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            seq = 0

            def row(key: int) -> pa.RecordBatch:
                nonlocal seq
                ids, them = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
                seq += 1
                lane, block = (key, None) if kind else (None, key)
                least = None if kind else first_bounds(ids, them, *shared.value[1:], k).tobytes()
                # in as few bytes as hold them
                narrow = them.astype(np.int32)
                them = narrow if (narrow == them).all() else them
                return pa.RecordBatch.from_pylist(
                    [{"lane": lane, "block": block, "kind": kind, "seq": seq, "ids": ids.tobytes(), "vectors": them.tobytes(), "least": least}],
                    schema=pa.schema([("lane", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("seq", pa.int64()), *((c, pa.binary()) for c in ("ids", "vectors", "least"))]),
                )

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, ids = batch.column(of).to_numpy(), batch.column("vec_id").to_numpy()
                them = matrix(batch.column("v"))
                for key in np.unique(keys):
                    at = keys == key
                    held.setdefault(int(key), []).append((ids[at], them[at]))
                    if sum(len(x) for x, _ in held[int(key)]) >= chunk:
                        yield row(int(key))
            for key in list(held):
                yield row(key)

        return run

    # descending length within a lane; a lane's rows stay in one partition
    chunks = (
        rows.withColumn("lane", F.pmod(F.xxhash64("vec_id"), F.lit(lanes)).cast("int"))
        .repartition(lanes, "lane")
        .sortWithinPartitions("lane", F.desc("square"), "vec_id")
        .select("lane", "vec_id", "v")
        .mapInArrow(pack("lane", 1), packed)
    )
    queries = (
        rows.filter("asks")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .repartition(min(lanes, blocks), "block")
        .sortWithinPartitions("block")
        .select("block", "vec_id", "v")
        .mapInArrow(pack("block", 0), packed)
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    meet = chunks.withColumn("block", every(blocks)).unionByName(queries.withColumn("lane", every(lanes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, asked = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                wide = np.int64 if len(r["vectors"]) == 8 * dim * len(ids) else np.int32
                them = np.frombuffer(r["vectors"], wide).reshape(len(ids), dim)
                if (r["block"], r["lane"]) != now:
                    if search:
                        yield search.found()
                    now, search, asked = (r["block"], r["lane"]), None, []
                if r["kind"] == 0:
                    asked.append((ids, them, np.frombuffer(r["least"])))
                elif asked:
                    if search is None:
                        search = Search(*(np.concatenate(x) for x in zip(*asked, strict=True)), shared.value[0], k, lead)
                    search.feed(ids, them)
        if search:
            yield search.found()

    dealt = meet.repartition(lanes, "block", "lane").sortWithinPartitions("block", "lane", "kind", "seq")
    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op2_topk": op2_topk}

SQL = {
    "op2_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v)::BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q JOIN e c ON c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
}
