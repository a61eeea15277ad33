"""Inner products of many vectors with many: matrices in tasks, only the best of each query sent on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a block of questions and of a block of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 4096


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(dim))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    # first by the largest component, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Best:
    """For each of some queries the candidates for its k best scores in steps of a millionth, ties to the smaller id.

    Spark rounds the scores, and so decides about the step next to the last one
    kept: candidates of that stay, too, k of each step at the most.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.least = np.full(len(queries), -np.inf)
        self.q, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)

    def feed(self, rows: np.ndarray, ids: pa.Array) -> None:
        """Take in unit rows and their ids."""
        self.scored(rows @ self.queries.T, ids)

    def scored(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Take in the scores of rows with all queries."""
        steps = np.floor(scores * 1e6 + 0.5)
        if len(ids) > self.k:
            kth = np.partition(steps, -self.k, axis=0)[-self.k]
            self.least = np.maximum(self.least, kth)
        # minus infinity stands for no score at all
        row, q = np.nonzero((steps >= self.least - 1) & (scores > -np.inf))
        self.q = np.concatenate([self.q, q])
        self.scores = np.concatenate([self.scores, scores[row, q]])
        new = ids.take(pa.array(row))
        self.ids = new if self.ids is None else pa.concat_arrays([self.ids, new])
        if len(self.q) > 4 * (self.k + 1) * max(len(self.least), 64):
            self.shrink()

    def shrink(self) -> None:
        if self.ids is None or not len(self.q):
            return
        steps = np.floor(self.scores * 1e6 + 0.5)
        place = np.empty(len(self.ids), np.int64)
        place[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        order = np.lexsort((place, -steps, self.q))
        q, s = self.q[order], steps[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(nth == self.k - 1)
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        # k of each step at the most
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(fresh)
        within = np.arange(len(q)) - starts[np.cumsum(fresh) - 1]
        keep = order[(s >= self.least[q] - 1) & (within < self.k)]
        self.q, self.scores, self.ids = self.q[keep], self.scores[keep], self.ids.take(pa.array(keep))

    def found(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.shrink()
        if self.ids is not None and len(self.q):
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.q)), self.ids, pa.array(self.scores)], ["query_id", "chunk_id", "score"])


def held_queries(queries: DataFrame) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """By length the ids and unit rows of a small set of queries (query_id, vector)."""
    rows = queries.select("query_id", "vector").toArrow()
    ids = rows.column("query_id").combine_chunks()
    return {them.shape[1]: (ids.take(pa.array(at)), unit_rows(them)) for at, them in by_length(rows.column("vector"))} if len(rows) else {}


def kinds(vectors: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()


def with_few(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score), the candidates of each task: all queries are one matrix a length in every task."""
    held = vectors.sparkSession.sparkContext.broadcast(held_queries(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(them, k) for dim, (_, them) in held.value.items()}
        for batch in batches:
            for at, rows in by_length(batch.column("vector")) if batch.num_rows else ():
                if rows.shape[1] in best:
                    for i in range(0, len(at), VECTOR_BLOCK):
                        some = at[i : i + VECTOR_BLOCK]
                        best[rows.shape[1]].feed(unit_rows(rows[i : i + VECTOR_BLOCK]), batch.column("chunk_id").take(pa.array(some)))
        for dim, b in best.items():
            yield from b.found(held.value[dim][0])

    return vectors.select("chunk_id", "vector").mapInArrow(run, "query_id {}, chunk_id {}, score double".format(*kinds(vectors, queries)))


def with_many(vectors: DataFrame, queries: DataFrame, k: int, n: int) -> DataFrame:
    """The same for any number of queries: blocks of queries meet blocks of vectors, a matrix product a pair.

    Vectors stay in lanes, in the order in which they come; what a block of
    queries has found in its lane so far is the bound for the next.
    """
    spark = vectors.sparkSession
    query_kind, chunk_kind = kinds(vectors, queries)
    blocks, lanes = max(1, -(-n // QUERY_BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"dim int, block int, lane int, kind int, seq long, asked array<{query_kind}>, held array<{chunk_kind}>, data binary"
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["chunk_id"].dataType)]
    fields = pa.schema([(c, pa.int32()) for c in ("dim", "block", "lane", "kind")] + [("seq", pa.int64()), ("asked", pa.list_(types[0])), ("held", pa.list_(types[1])), ("data", pa.binary())])

    def packed(key: str, kind: int, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seq = 0
            for batch in batches:
                for at, rows in by_length(batch.column("vector")) if batch.num_rows else ():
                    where = batch.column(key).to_numpy()[at]
                    for slot in np.unique(where):
                        own = np.flatnonzero(where == slot)
                        for i in range(0, len(own), most):
                            some = own[i : i + most]
                            ids = batch.column(0).take(pa.array(at[some])).to_pylist()
                            seq += 1
                            out = {"dim": rows.shape[1], key: int(slot), "kind": kind, "seq": seq, ("held" if kind else "asked"): ids, "data": unit_rows(rows[some]).tobytes()}
                            yield pa.RecordBatch.from_pylist([dict.fromkeys(fields.names) | out], schema=fields)

        return run

    # vectors go to lanes as they come, a batch at a time: which lane does not matter
    chunks = vectors.select("chunk_id", "vector", F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")).mapInArrow(packed("lane", 1, VECTOR_BLOCK), schema)
    dealt = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = dealt.repartition(min(lanes, blocks), "block").mapInArrow(packed("block", 0, QUERY_BLOCK), schema)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    meet = chunks.withColumn("block", every(blocks)).unionByName(asked.withColumn("lane", every(lanes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, best = None, [], [], None
        done = lambda: best.found(pa.array(ids, types[0])) if best else iter(())
        for batch in batches:
            for r in batch.to_pylist():
                if (r["dim"], r["block"], r["lane"]) != now:
                    yield from done()
                    now, ids, parts, best = (r["dim"], r["block"], r["lane"]), [], [], None
                rows = np.frombuffer(r["data"]).reshape(-1, r["dim"])
                if r["kind"] == 0:
                    ids += r["asked"]
                    parts.append(rows)
                elif parts:
                    best = best or Best(np.concatenate(parts), k)
                    best.feed(rows, pa.array(r["held"], types[1]))
        yield from done()

    pairs = meet.repartition(lanes, "dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "kind", "seq")
    return pairs.mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, score double")


def late_interaction(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score), the candidates of each task: for each vector of a question the largest product with one of the document's, added up.

    documents (chunk_id, vectors) and queries (query_id, vectors) have arrays of
    vectors of one length, which are taken as they are. The questions are a
    stated set that goes to every task; each batch of documents is one product
    with all their vectors. Documents and questions without vectors, and those
    of another length than the questions' first, take no part.
    """
    rows = queries.filter("size(vectors) > 0").select("query_id", "vectors").toArrow()
    nested = rows.column("vectors").combine_chunks() if len(rows) else None
    dim = len(nested[0][0]) if len(rows) else 0
    flat = [[v for v in them if v is not None and len(v) == dim] for them in (nested.to_pylist() if len(rows) else [])]
    ids = rows.column("query_id").combine_chunks() if len(rows) else None
    counts = np.array([len(x) for x in flat], np.int64)
    matrix = np.array([v for them in flat for v in them], np.float64).reshape(-1, max(dim, 1))
    held = documents.sparkSession.sparkContext.broadcast((ids, counts, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, matrix = held.value
        some = np.flatnonzero(counts > 0) if ids is not None else []
        if not len(some):
            return
        starts = np.cumsum(counts) - counts
        best = Best(np.zeros((len(counts), 0)), k)
        for batch in batches:
            column = batch.column("vectors")
            for i in range(0, batch.num_rows, 512):
                part = column.slice(i, 512)
                n = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                tokens = part.flatten()
                fits = pc.list_value_length(tokens).to_numpy(zero_copy_only=False) == dim
                owner = np.repeat(np.arange(len(n)), np.nan_to_num(n).astype(np.int64))[fits]
                docs, first = np.unique(owner, return_index=True)
                if not len(docs):
                    continue
                them = tokens.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                # the best of each document for each vector of a question, then sums over the question's
                most = np.maximum.reduceat(them @ matrix.T, first, axis=0)
                scores = np.full((len(docs), len(counts)), -np.inf)
                scores[:, some] = np.add.reduceat(most, starts[some], axis=1)
                best.scored(scores, batch.column("chunk_id").take(pa.array(docs + i)))
        yield from best.found(ids)

    return documents.select("chunk_id", "vectors").mapInArrow(run, "query_id {}, chunk_id {}, score double".format(*kinds(documents, queries)))


def weighted_terms(chunks: DataFrame, weights: list[tuple], queries: list, kind: str, avgdl: float, share, k: int) -> DataFrame:
    """(query_id, chunk_id, score), the candidates of each task: sums of weighted terms for all questions at once.

    chunks has chunk_id, dl and terms, an array of (term, tf); weights are
    (place of the question, term, weight), a stated set that goes to every task
    as one matrix. A batch of chunks is a matrix of share(tf, dl, avgdl).
    """
    terms = sorted({t for _, t, _ in weights})
    place = {t: i for i, t in enumerate(terms)}
    matrix = np.zeros((len(terms), len(queries)))
    for q, t, w in weights:
        matrix[place[t], q] = w
    held = chunks.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), matrix, queries))
    query_kind = to_arrow_type(chunks.sparkSession.createDataFrame([], f"q {kind}").schema["q"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, matrix, queries = held.value
        best, asked = Best(np.zeros((len(queries), 0)), k), (matrix > 0).astype(float)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                lists = part.column("terms")
                flat = lists.flatten()
                at = pc.index_in(flat.field("term"), terms)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[known]
                if not len(owner):
                    continue
                column = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                tf, dl = flat.field("tf").to_numpy(zero_copy_only=False)[known].astype(float), part.column("dl").to_numpy(zero_copy_only=False)[owner]
                rows = np.zeros((len(lists), len(terms)))
                rows[owner, column] = share(tf, dl, avgdl)
                # a chunk without any of a question's terms has no score for it
                scores = np.where((rows > 0).astype(float) @ asked > 0, rows @ matrix, -np.inf)
                best.scored(scores, part.column("chunk_id"))
        yield from best.found(pa.array(queries, query_kind))

    return chunks.select("chunk_id", "dl", "terms").mapInArrow(run, f"query_id {kind}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double")
