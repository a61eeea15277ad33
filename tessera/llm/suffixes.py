"""Removal of long strings that occur more than once, by suffix buckets and a difference cover."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table, utf8

U = np.uint64
#: Bytes of text that are worked on at once.
PACK = 2_000_000


@functools.cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """A period v of at most `most`, and a least set of residues whose differences give each residue.

    Singer's construction: with q prime and v = q * q + q + 1, the powers of a
    primitive element of the field of q ** 3 elements that lie in a plane.
    """
    primes = [q for q in range(2, max(3, int(most**0.5) + 1)) if all(q % d for d in range(2, q)) and q * q + q + 1 <= most]
    if not primes:
        return 1, np.zeros(1, np.int64)
    q = primes[-1]
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # powers of x where x ** 3 = a x ** 2 + b x + c
                power, plane, i = (0, 0, 1), [], 0
                while i == 0 or power != (0, 0, 1):
                    if power[0] == 0 and i < v:
                        plane.append(i)
                    high, middle, low = power
                    power = ((middle + high * a) % q, (low + high * b) % q, high * c % q)
                    i += 1
                if i == q**3 - 1:
                    return v, np.array(plane)
    raise AssertionError("each finite field has a primitive element")


#: Fingerprints are polynomials modulo this prime: two different strings of n bytes agree in one of them for n of all bases at
#: most, whatever the bytes. (Modulo a power of two there are strings that agree for each base.)
PRIME = (1 << 31) - 1
#: Two pairs of bases, drawn once and for all; the pairs do not depend on each other.
BASES = tuple(int(x) for x in np.random.default_rng(20_251).integers(1 << 20, PRIME - 1, 4))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2 ** 62."""
    for _ in range(2):
        high = x >> U(31)
        x = x & U(PRIME)
        x += high
    return np.where(x >= U(PRIME), x - U(PRIME), x)


@functools.lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo the prime for i below n, in four bytes each."""
    out, step = np.ones(1, U), base
    while len(out) < n:
        out = np.concatenate([out, _reduced(out * U(step))])
        step = step * step % PRIME
    return out.astype(np.uint32)


class Prints:
    """62-bit fingerprints of any window of a buffer, from prefix sums of two polynomials."""

    def __init__(self, data: np.ndarray, which: int):
        # sizes in steps, so that a worker keeps one table of powers
        n = max(1 << (len(data) - 1).bit_length(), PACK * 2) if len(data) else 1
        self.parts = []
        for base in BASES[2 * which : 2 * which + 2]:
            terms = np.multiply(data, _powers(base, n)[: len(data)], dtype=U)
            # sums stay below 2 ** 62: terms are below 2 ** 39, or 2 ** 31 where there are more than 2 ** 23 of them
            if len(terms) > 1 << 23:
                terms = _reduced(terms)
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(terms, dtype=U, out=sums[1:])
            self.parts.append((sums, _powers(pow(base, -1, PRIME), n)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x, y = (_reduced(_reduced(sums[end] - sums[start]) * down[start]) for sums, down in self.parts)
        h = (x << U(31)) | y
        # all bits of a fingerprint tell in each part of it
        h ^= h >> U(29)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(29))


class Pack:
    """Some whole documents in one buffer, with the samples that the difference cover picks."""

    def __init__(self, data: bytes, sizes: np.ndarray, length: int, buckets: int):
        self.data, self.length, self.buckets = np.frombuffer(data, np.uint8), length, buckets
        self.sizes = sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.v, cover = difference_cover(length * 2 // 3)
        self.prefix = length - self.v + 1
        # texts shorter than a string have none
        long = sizes >= length
        periods = np.where(long, -(-sizes // self.v), 0)
        first = np.repeat(self.starts, periods) + self.v * (np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods))
        at = (first[:, None] + cover[None, :]).ravel()
        of = np.repeat(np.repeat(np.arange(len(sizes)), periods), len(cover))
        inside = at + self.prefix <= self.ends[of]
        self.at, of = at[inside], of[inside]
        # the strings that hold a sample start from low to high
        self.low = np.maximum(self.at - (self.v - 1), self.starts[of])
        self.high = np.minimum(self.at, self.ends[of] - length)
        self.prints = Prints(self.data, 0)
        self.key = self.prints.of(self.at, self.at + self.prefix)
        around = self.prints.of(self.low, self.high + length)
        # the same bytes at another place of their context are another context
        place = (self.at - self.low) * (length + 1) + (self.high - self.at + length)
        self.context = (around ^ (place.astype(U) * U(0x9E3779B97F4A7C15))) >> U(25)

    def distinct(self) -> Distinct:
        return Distinct(self.key, self.context, self.buckets)

    def starts_in(self, chosen: np.ndarray) -> np.ndarray:
        """All starts of strings that hold one of the chosen samples."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.low[chosen], 1)
        np.add.at(edge, self.high[chosen] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class Distinct:
    """Pairs of a key and a second number, each once, with whether it came more than once, cut into buckets of the key."""

    def __init__(self, key: np.ndarray, second: np.ndarray, buckets: int):
        order = np.lexsort((second, key))
        k, s = key[order], second[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        heads = np.flatnonzero(fresh)
        self.key, self.second = k[heads], s[heads]
        self.many = np.diff(np.append(heads, len(k))) > 1
        #: For each pair the place it came from first; for each place its pair.
        self.first = order[heads]
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        bucket = ((self.key >> U(32)) * U(buckets)) >> U(32)
        self.bounds = np.searchsorted(bucket, np.arange(buckets + 1).astype(U))

    def rows(self, pack: int, key_bytes: int, second_bytes: int) -> pa.RecordBatch:
        """One row a bucket: the keys' highest bytes, as steps from one to the next, and the second numbers below the mark for many.

        Each byte's values lie together, so that the steps' empty high bytes are compressed away.
        """
        keys = self.key >> U(64 - 8 * key_bytes)
        steps = keys.copy()
        steps[1:] -= keys[:-1]
        full = np.flatnonzero(np.diff(self.bounds))
        steps[self.bounds[full]] = keys[self.bounds[full]]
        flagged = self.second | (self.many.astype(U) << U(8 * second_bytes - 1))
        packed = np.concatenate([_low_bytes(steps, key_bytes), _low_bytes(flagged, second_bytes)], axis=1)
        blobs = [packed[self.bounds[b] : self.bounds[b + 1]].T.tobytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), pack)), pa.array(blobs, pa.binary())], ["bucket", "pack", "blob"])

    def answers(self, rows: list[dict] | None) -> np.ndarray:
        """What the buckets said about each pair."""
        out = np.zeros(len(self.key), np.uint8)
        for r in rows or ():
            out[self.bounds[r["bucket"]] : self.bounds[r["bucket"] + 1]] = np.frombuffer(r["blob"], np.uint8)
        return out


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _numbers(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), 8), np.uint8)
    wide[:, : x.shape[1]] = x
    return wide.view("<u8").ravel()


TWICE, SHOW = 1, 2


def judge_samples(key: np.ndarray, context: np.ndarray, many: np.ndarray) -> np.ndarray:
    """TWICE where the whole context occurs again; SHOW for one of each context of keys that have several."""
    out = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable")
    k = key[order]
    again = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    again[1:] |= same
    again[:-1] |= same
    out[many] = TWICE
    order = order[again]
    # the ranks of equal samples are told apart by their contexts
    order = order[np.lexsort((context[order], key[order]))]
    k, c = key[order], context[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    twice = size > 1
    np.logical_or.at(twice, group, many[order])
    of_key = np.cumsum(new_key) - 1
    contexts = np.bincount(of_key, new)
    out[order] = TWICE * twice[group] + SHOW * (new & (contexts[of_key] > 1))
    return out


def judge_strings(key: np.ndarray, second: np.ndarray, many: np.ndarray) -> np.ndarray:
    """TWICE where the string occurs again."""
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    out = many.astype(np.uint8)
    out[order[1:][same]] = TWICE
    out[order[:-1][same]] = TWICE
    return out


def _packs(docs: DataFrame) -> DataFrame:
    """(pack, ids, sizes, data): the documents of a partition in buffers of about PACK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in slices(batches, "text", PACK):
            texts = utf8(batch.column("text"))
            pack = (TaskContext.get().partitionId() << 24) + seq
            seq += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pack]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                    pa.array([b"".join(texts)], pa.binary()),
                ],
                ["pack", "ids", "sizes", "data"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "pack long, ids array<long>, sizes array<int>, data binary")


def repeated_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): what of each text's UTF-8 bytes is covered by strings of `length` that start elsewhere too.

    `spans` are the maximal runs (start, end) of such bytes, `kept` the other
    bytes. Strings do not cross documents, may overlap, and are judged on the
    texts as they are.

    A difference cover with period v picks samples of all positions such that
    any two equal strings hold samples at equal places, whose first
    length - v + 1 bytes are equal. Samples are dealt into buckets by a
    fingerprint of these bytes, and each bucket is sorted by itself. Ties are
    resolved by the samples' context, all strings that hold the sample: where
    it occurs twice, all these strings do. Only where equal samples have
    different contexts are the strings themselves shown, by one document for
    each context, and sorted by bucket in the same way. So memory is bounded
    by a bucket. Pairs that a buffer of documents holds many times are sent
    once, so that copies by the million do not meet in one task.

    Samples are told apart by 48 bits, which can only add strings that are
    shown, contexts by 39 bits more, strings by 77 bits. Null text counts as empty; rows with null or repeated doc_id are
    documents like others; one row a document; an empty table gives no rows;
    further columns are ignored.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    packs = _packs(docs).repartition(n, "pack")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Pack]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row, Pack(row["data"], np.array(row["sizes"], np.int64), length, buckets)

    def shown(pack: Pack, said: np.ndarray, distinct: Distinct) -> tuple[np.ndarray, Distinct]:
        starts = pack.starts_in(distinct.first[(said & SHOW) > 0])
        second = Prints(pack.data, 1)
        return starts, Distinct(pack.prints.of(starts, starts + length), second.of(starts, starts + length) >> U(49), buckets)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pack in opened(batches):
            yield pack.distinct().rows(row["pack"], 6, 5)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pack in opened(batches):
            distinct = pack.distinct()
            _, found = shown(pack, distinct.answers(row["said"]), distinct)
            yield found.rows(row["pack"], 8, 2)

    def judged(sent: DataFrame, key_bytes: int, second_bytes: int, judge) -> DataFrame:
        """Sort one bucket at a time; (pack, said) has all answers to a buffer."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, bytes]] = []
            now = None

            def answer() -> pa.RecordBatch:
                width = key_bytes + second_bytes
                tables = [np.frombuffer(b, np.uint8).reshape(width, -1).T for _, b in held]
                keys = np.concatenate([np.cumsum(_numbers(x[:, :key_bytes]), dtype=U) for x in tables])
                flagged = np.concatenate([_numbers(x[:, key_bytes:]) for x in tables])
                mark = U(8 * second_bytes - 1)
                said = judge(keys, flagged & ((U(1) << mark) - U(1)), (flagged >> mark) > 0)
                ends = np.cumsum([len(x) for x in tables])
                # a buffer hears only of buckets with something to say
                parts = [(p, x) for (p, _), x in zip(held, np.split(said, ends[:-1]), strict=True) if x.any()]
                return pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in parts], pa.int64()), pa.array([now] * len(parts), pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())],
                    ["pack", "bucket", "blob"],
                )

            for batch in batches:
                for bucket, pack, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pack", "blob")), strict=True):
                    if bucket != now and held:
                        yield answer()
                        held.clear()
                    now = bucket
                    held.append((pack, blob))
            if held:
                yield answer()

        dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "pack")
        said = dealt.mapInArrow(run, "pack long, bucket int, blob binary")
        return said.groupBy("pack").agg(F.collect_list(F.struct("bucket", "blob")).alias("said"))

    row = "bucket int, pack long, blob binary"
    about_samples = judged(packs.mapInArrow(samples, row), 6, 5, judge_samples)
    with_samples = packs.join(about_samples, "pack", "left")
    about_strings = judged(with_samples.mapInArrow(strings, row), 8, 2, judge_strings)
    whole = with_samples.join(about_strings.withColumnRenamed("said", "said_of_strings"), "pack", "left")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for row, pack in opened(batches):
            distinct = pack.distinct()
            said = distinct.answers(row["said"])
            edge = np.zeros(len(pack.data) + 1, np.int32)
            twice = np.flatnonzero((said & TWICE)[distinct.of])
            np.add.at(edge, pack.low[twice], 1)
            np.add.at(edge, pack.high[twice] + length, -1)
            starts, found = shown(pack, said, distinct)
            again = starts[found.answers(row["said_of_strings"])[found.of] > 0]
            np.add.at(edge, again, 1)
            np.add.at(edge, again + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans, kept = [], []
            for start, end in zip(pack.starts, pack.ends, strict=True):
                own = gone[start:end]
                if own.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([{"start": a, "end": b} for a, b in turns.tolist()])
                    kept.append(pack.data[start:end][~own].tobytes())
                else:
                    spans.append([])
                    kept.append(pack.data[start:end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(pack.sizes), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    return whole.mapInArrow(cover, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL: dict[str, str] = {}
