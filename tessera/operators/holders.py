"""Texts that hold other texts: their first pieces meet by hash, then the whole is compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieve import small

#: Questions meet texts by their first so many bytes, three numbers of 64 bits; shorter ones are compared with all texts.
PIECE = 24
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes of text that are hashed at once.
MOST = 4_000_000


def piece_hashes(data: bytes) -> np.ndarray:
    """A hash of the PIECE bytes from each place on, as far as there are so many."""
    n = len(data) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n + 16,), "<u8", data, strides=(1,))
    out = words[:n] * FACTORS[0]
    for i in (1, 2):
        out ^= out >> np.uint64(29)
        out += words[8 * i : 8 * i + n] * FACTORS[i]
    return out ^ (out >> np.uint64(32))


def holders(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of all documents (chunk_id, text) that hold the whole text of a question (query_id, query).

    What holds a text holds its first piece. Tasks hash the pieces from each
    place of their texts on, and send on those that questions begin with; only
    the numbers of these go to all tasks. Null texts hold nothing and are in
    nothing; an empty question is in every other.
    """
    long = F.octet_length("query") >= PIECE

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(piece_hashes(q.encode()[:PIECE])[0]) for q in batch.column("query").to_pylist()]
            hashes = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), hashes], ["query_id", "query", "h"])

    kind = asked.schema["query_id"].dataType.simpleString()
    keys = asked.filter(long).select("query_id", "query").mapInArrow(first, f"query_id {kind}, query string, h long")
    wanted = np.unique(keys.select("h").distinct().toArrow().column("h").to_numpy().view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        marked = np.zeros(1 << 20, bool)
        marked[wanted & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            at, hashes = [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                data, seen = text.as_py(), []
                for i in range(0, max(len(data) - PIECE + 1, 0), MOST):
                    h = piece_hashes(data[i : i + MOST + PIECE - 1])
                    h = h[marked[h & np.uint64((1 << 20) - 1)]]
                    seen.append(np.intersect1d(h, wanted))
                for h in np.unique(np.concatenate(seen)) if seen else ():
                    at.append(row)
                    hashes.append(h)
            found = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.array(hashes, np.uint64).view(np.int64))], ["chunk_id", "text", "h"])

    kind = docs.schema["chunk_id"].dataType.simpleString()
    texts = docs.select("chunk_id", "text").filter("text IS NOT NULL")
    near = texts.mapInArrow(hits, f"chunk_id {kind}, text string, h long")
    found = near.join(small(keys), "h").filter(F.contains("text", F.col("query"))).select("query_id", "chunk_id")
    short = asked.filter(~long).select("query_id", "query")
    return found.unionByName(texts.crossJoin(small(short)).filter(F.contains("text", F.col("query"))).select("query_id", "chunk_id"))
