"""Near-duplicates by the exact Jaccard similarity of sets of shingles: bitmaps in tiles, exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, utf8
from tessera.llm.components import connected_components

#: Sets can be near only if the least hashes of one band of ROWS agree. Two sets alike to s share none of the bands with
#: probability (1 - s ** ROWS) ** BANDS: at 0.8 that is 3.3 in a million.
BANDS, ROWS = 24, 4
_DICE = np.random.default_rng(20_240_607)
FLIPS = _DICE.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _DICE.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: A tile of a bucket holds about so many shingles.
TILE = 1_000_000
#: Eight counters in a 64-bit number, one for each bit of a byte, the highest bit first.
SPREAD = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype="<u8")


def shingle_digests(text: bytes, words: int, seed: int = 42) -> list[bytes]:
    """XXH64 of each run of `words` words in lower case; a shorter text is one shingle, one without words none."""
    digest = xxhash.xxh64_digest
    found = text.lower().split()
    if len(found) >= words:
        return [digest(x, seed) for x in map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))]
    return [digest(b" ".join(found), seed)] if found else []


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of big-endian 64-bit hashes (counts[i] of them, none empty) the bits that over half of them have."""
    spread = SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    # a counter holds 255 at most: add up pieces of as many hashes, then the pieces of each run
    ends = np.cumsum(counts)
    pieces = -(-counts // 255)
    firsts = np.repeat(ends - counts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.ascontiguousarray(np.add.reduceat(spread, firsts, axis=0)).view(np.uint8).reshape(len(firsts), 64)
    totals = np.add.reduceat(sums.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(2 * totals > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, words)), "<u8"))


def key_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, signed."""
    n = xxhash.xxh64_intdigest(shingles.tobytes())
    return n - ((n >> 63) << 64)


def bands_of(joined: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set, none empty, one hash a band of the least of its hashes under ROWS permutations."""
    firsts = np.cumsum(counts) - counts
    out = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(counts), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            h = (h ^ np.minimum.reduceat((joined ^ FLIPS[i]) * FACTORS[i], firsts)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[:, band] = h
    return out.view(np.int64)


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, key, n, bands): of every whole text the name and size of its set of shingles and its bands' hashes."""
    schema = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sets = [shingle_set(t, words) for t in utf8(batch.column("text"))]
            full = [s for s in sets if len(s)]
            joined, counts = np.concatenate([np.zeros(0, "<u8"), *full]), np.array([len(s) for s in full], np.int64)
            bands = iter(bands_of(joined, counts).tolist() if full else [])
            columns = [[key_of(s) for s in sets], [len(s) for s in sets], [next(bands) if len(s) else [] for s in sets]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return rows.select(F.col("row").cast("string"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "row string, doc_id long, key long, n int, bands array<long>"
    )


def shingles_of(texts: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of every text: its set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sets = [shingle_set(t, words) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "key long, shingles binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets, of which one is not empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (key, shingles) are alike to the similarity, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True)
            near = pa.array([jaccard(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similarity for a, b in both], pa.bool_())
            yield batch.select(["u", "v"]).filter(near)

    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the bits of those shingles that others have too, and how many it has for itself."""
    sizes = np.array([len(s) for s in sets])
    names, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = (np.cumsum(shared) - 1)[column]
    keep = shared[column]
    wide = max(1, -(-int(shared.sum()) // 64)) * 64
    out, rest, last = np.empty((len(sets), wide // 64), np.uint64), np.empty(len(sets), np.int64), 0
    for i, n in enumerate(sizes):
        own = place[last : last + n][keep[last : last + n]]
        row = np.zeros(wide, bool)
        row[own] = True
        out[i], rest[i] = np.packbits(row).view(np.uint64), n - len(own)
        last += n
    return out, rest


def tile_links(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, similarity: float, block: int = 1 << 21) -> list[tuple[int, int]]:
    """Links that join the same classes as all pairs of sets (of two sides, if given) with that Jaccard similarity do, labels being classes already.

    Sets are walked in order of size, which is the population count of their
    bitmaps; those whose counts differ by more than the similarity allows are
    skipped, all others are compared by exclusive-or and bit counts.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    bits, rest = bitmaps([sets[i] for i in order])
    size = sizes[order]
    class_ = np.unique(labels[order], return_inverse=True)[1]
    side = None if sides is None else sides[order]
    tops = np.searchsorted(size, size / similarity * (1 + 1e-12), side="right")
    step = max(1, block // bits.shape[1])
    out = []
    for i in range(len(order)):
        for start in range(i + 1, int(tops[i]), step):
            j = np.arange(start, min(start + step, int(tops[i])))
            j = j[class_[j] != class_[i]] if side is None else j[(class_[j] != class_[i]) & (side[j] != side[i])]
            if not len(j):
                continue
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) + rest[j] + rest[i]
            both = (size[i] + size[j] - apart) // 2
            for k in j[both / (size[i] + size[j] - both) >= similarity]:
                if class_[k] != class_[i]:
                    out.append((int(order[i]), int(order[k])))
                    class_[class_ == class_[k]] = class_[i]
    return out


def linked(members: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (u, v) of members (band, key, n, label, shingles) of one band that join all classes that are alike to the similarity.

    A band's members are dealt into tiles of about `tile` shingles by a hash;
    each two tiles of a band meet once, wherever Spark puts them. Only links
    between classes are sent, fewer than there are members.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.sum("n") / tile).cast("int").alias("parts"))
    dealt = members.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    tiles = cut(dealt.groupBy("band", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("key", "label", "shingles")).alias("tile")))
    first = tiles.select("band", "part", "tile", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"))
    # a tile meets itself without a join
    own = first.filter("part = other").select("tile", F.lit(None).cast(tiles.schema["tile"].dataType).alias("other_tile"))
    second = tiles.filter("part > 0").select("band", F.col("part").alias("other"), F.col("tile").alias("other_tile"))
    met = first.filter("part < other").join(second, ["band", "other"]).select("tile", "other_tile")

    def opened(tile: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = tile.values
        keys, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("key", "label"))
        return keys, labels, [np.frombuffer(x, "<u8") for x in rows.field("shingles").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                keys, labels, sets = opened(batch.column("tile")[k])
                sides = None
                if batch.column("other_tile")[k].is_valid:
                    more = opened(batch.column("other_tile")[k])
                    sides = np.arange(len(keys) + len(more[0])) < len(keys)
                    keys, labels, sets = np.concatenate([keys, more[0]]), np.concatenate([labels, more[1]]), sets + more[2]
                out += [(int(keys[i]), int(keys[j])) for i, j in tile_links(sets, labels, sides, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(met).repartition(n).mapInArrow(run, "u long, v long")


def classes_of(rows: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, label): of each set that is linked the least key of its class; `found` is what sets_of gives for the rows.

    In each bucket of a band all sets are first compared with one of them,
    which joins the large groups of copies; what is in different classes after
    that is compared in tiles. All links are exact similarities.
    """
    one = cut(found.groupBy("key").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    buckets = one.select("key", "n", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min(F.struct("key", "n")).alias("hub"), F.count("*").alias("members")).filter("members > 1").select("band", "hub")
    shared = cut(buckets.join(hubs, "band"))
    wanted = cut(shared.select("key").distinct())
    held = rows.join(one.join(wanted, "key", "left_semi").select("row"), "row", "left_semi")
    sets = cut(shingles_of(held, words).groupBy("key").agg(F.min("shingles").alias("shingles")))
    # nothing is lost by sizes: the smaller set has at least that share of the larger
    sized = lambda n, m: F.least(n, m) / F.greatest(n, m) >= similarity
    stars = shared.filter((F.col("key") != F.col("hub.key")) & sized(F.col("n"), F.col("hub.n"))).select(F.col("hub.key").alias("u"), F.col("key").alias("v")).distinct()
    labels = cut(connected_components(verified(stars, sets, similarity)))
    named = cut(shared.join(labels, shared["key"] == labels["node"], "left").select("band", "key", "n", F.coalesce("label", "key").alias("label"), F.col("hub.key").alias("hub")))
    mixed = named.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members")).filter("least < most AND members > 2")
    left = named.join(mixed.select("band"), "band", "left_semi").filter("key <> hub").drop("hub").join(sets, "key")
    more = cut(linked(left, similarity))
    if more.isEmpty():
        return labels
    return connected_components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))


def row_key() -> Column:
    """A name of a row by its doc_id and text; rows that share it are the same document, null text being empty."""
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
