"""SimHash near-duplicates by an exact comparison in tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import cut, free_names, named, slices, table, utf8
from tessera.llm.components import connected_components, union
from tessera.llm.shingles import majority_bits, shingle_digests


def fingerprints_of(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints, where a bit is set if over half of the shingles' XXH64 have it."""
    found = [shingle_digests(text, words, seed) for text in texts]
    counts = np.array([len(x) for x in found], np.int64)
    full = np.flatnonzero(counts)
    out = np.zeros(len(texts), np.uint64)
    if len(full):
        out[full] = majority_bits(np.frombuffer(b"".join(h for x in found for h in x), ">u8"), counts[full])
    return out


def fingerprints(docs: DataFrame, words: int = 3, kind: str = "long") -> DataFrame:
    """(doc_id, fp) of every whole text; doc_id is of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            prints = fingerprints_of(utf8(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the same components as all links between a and b, or within a if they are one.

    Both are sorted into tiles of equal population counts of the high and the
    low half. A tile meets those whose counts differ by the radius at most in
    sum, in exclusive-or and bit counts; all other pairs of tiles are skipped.
    """
    own = a is b
    half = lambda x, shift: np.bitwise_count((x >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # 33 counts of the low half and as many again that none has, so that a range of counts stays within a high half's tiles
    cell = lambda x: half(x, 32) * 99 + half(x, 0)
    cells_a, cells_b = cell(a), cell(b)
    order_a, order_b = np.argsort(cells_a, kind="stable"), np.argsort(cells_b, kind="stable")
    a, cells_a, b, cells_b = a[order_a], cells_a[order_a], b[order_b], cells_b[order_b]
    nodes = np.unique(np.concatenate([a, b]))
    labels = np.arange(len(nodes))
    at_a, at_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    tiles, starts = np.unique(cells_a, return_index=True)
    for tile, start, end in zip(tiles.tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        for high in range(0 if own else -radius, radius + 1):
            spare = radius - abs(high)
            # within one set each two tiles meet once
            least = 0 if own and not high else -spare
            low, top = np.searchsorted(cells_b, [tile + 99 * high + least, tile + 99 * high + spare + 1]).tolist()
            if low == top:
                continue
            step = max(1, block // (top - low))
            for i in range(start, end, step):
                u, v = np.nonzero(np.bitwise_count(a[i : min(i + step, end), None] ^ b[None, low:top]) <= radius)
                union(labels, at_a[i + u], at_b[low + v])
    rest = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[labels[rest]], nodes[rest]


def links(prints: DataFrame, radius: int = 3, group: int = 1 << 20) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within `radius` bits, maybe over others.

    Fingerprints are dealt into groups by a hash, `group` on average at most;
    each two groups meet in one task, which compares their tiles. So a
    fingerprint is sent once for each group, not for each tile that it meets,
    and no count of bits makes a task larger than others.
    """
    spark = prints.sparkSession
    own = cut(prints.select("fp").distinct())
    total, n = own.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # more pairs than tasks, so that these are alike; none for a few fingerprints
    groups = max(1, -(-total // group), min(math.isqrt(8 * n) + 1, -(-total // 2048)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            of = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
            order = np.argsort(of, kind="stable")
            there, starts = np.unique(of[order], return_index=True)
            parts = np.split(fps[order], starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["own", "fps"])

    rows = own.mapInArrow(deal, "own int, fps binary").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meet = rows.select(F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        now = None

        def compared() -> pa.RecordBatch:
            sides = [np.frombuffer(b"".join(held.get(k, ())), np.uint64) for k in now]
            u, v = tile_links(sides[0], sides[0] if now[0] == now[1] else sides[1], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            for first, second, k, fps in zip(*(batch.column(c).to_pylist() for c in ("first", "second", "own", "fps")), strict=True):
                if (first, second) != now:
                    if held:
                        yield compared()
                    held, now = {}, (first, second)
                held.setdefault(k, []).append(fps)
        if held:
            yield compared()

    return meet.repartition(n, "first", "second").sortWithinPartitions("first", "second", "own").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, kind: str = "long") -> DataFrame:
    """(doc_id, fp, component_id): the classes of the relation "at most `radius` bits differ", closed over chains.

    component_id is the least doc_id of the class. Every text counts, null as
    empty; texts without words have fingerprint 0 and are linked like others.
    Rows with a null doc_id get a component only from others, and stay null
    alone. Repeated doc_ids give as many rows. An empty table gives no rows;
    further columns are ignored. doc_id is of that kind, a number or a string.
    """
    prints = cut(fingerprints(docs, words, kind))
    classes = connected_components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = least.join(classes, least["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    labelled = cut(labelled)
    ids = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    ids = cut(labelled.join(ids, "label").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, label): the classes of the relation "the sets of shingles have at least that Jaccard similarity", closed over chains.

    `row` names the row by its doc_id and text (shingles.row_key), `label` the
    class. A radius on 64-bit fingerprints cannot tell a similarity of 0.8, so
    candidates share one of 24 bands of least hashes, which leaves out 3.3
    pairs in a million at 0.8 (more below, fewer above); those that a common
    neighbour has not joined already are compared in tiles of bitmaps of their
    shingles, by exclusive-or and bit counts. Each link is the exact similarity
    of both sets.

    Every text counts, null as empty; texts without words are one class.
    Repeated rows and null doc_ids give as many rows. An empty table gives no
    rows; further columns are ignored.
    """
    rows = docs.select(shingles.row_key().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut(shingles.sets_of(rows, words))
    classes = shingles.classes_of(rows, found, words, similarity)
    keys = found.select("doc_id", "row", "key")
    return keys.join(classes, keys["key"] == classes["node"], "left").select("doc_id", "row", F.coalesce("label", "key").alias("label"))


def joined_classes(found: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, row, label) of found, classes that share a class of near (row, component_id) being one."""
    pairs = cut(found.join(near.dropDuplicates(["row"]), "row").select("component_id", "label").distinct())
    least = pairs.groupBy("component_id").agg(F.min("label").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    classes = connected_components(pairs.join(least, "component_id").select("u", F.col("label").alias("v")))
    merged = classes.select("node", F.col("label").alias("to"))
    return found.join(merged, found["label"] == merged["node"], "left").select("doc_id", "row", F.coalesce("to", "label").alias("label"))


def one_of_each_class(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """Of each class of similar texts one row, with all its columns: that of the least doc_id, null being last, then of the least text hash.

    With a radius, texts whose fingerprints differ by so many bits at most are
    of one class, too (near_duplicates). Rows that repeat doc_id and text are
    one, of which any stays. So of rows that share a doc_id but not the text
    each is judged by its own text.
    """
    (row,) = free_names(docs.columns, "row")
    found = cut(similar_texts(docs, words, similarity))
    if radius is not None:
        near = near_duplicates(docs.select(shingles.row_key().alias("doc_id"), "text"), radius=radius, kind="string")
        found = joined_classes(found, near.select(F.col("doc_id").alias("row"), "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    best = cut(found.groupBy("label").agg(first).select(F.col("first.row").alias(row)))
    # rows are made distinct where they are read, so that very many repeated ones do not meet in one task
    once = docs.withColumn(row, shingles.row_key()).dropDuplicates([row])
    return once.join(best, row, "left_semi").select(*(named(c) for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
