"""Hard negatives by rotated one-bit codes, with an interval for each score that holds for certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.vectors import as_doubles, exact, in_64_bits, matrix, narrow, order_of, whole, widened

#: Codes have a bit for each direction of so many rotations, as far as these take no more than so many bytes.
TURNS, FRAME_BYTES = 8, 64_000_000
#: A query's rotated components are rounded to so many bits.
PLANES = 4
#: So many queries and rows are compared at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 2048


def directions(dim: int, turns: int) -> np.ndarray:
    """Rows of random rotations, the same in every run, filled up to whole words of 64 bits. One rotation at least is made."""
    dice = np.random.default_rng(11)
    turns = max(1, min(turns, FRAME_BYTES // (4 * dim * dim)))
    rows = np.concatenate([np.linalg.qr(dice.normal(size=(dim, dim)))[0] for _ in range(turns)])
    return np.concatenate([rows, np.zeros((-len(rows) % 64, dim))]).astype(np.float32)


class Codes:
    """One-bit codes of vectors: the signs in each direction, and how each vector lies to what its code stands for.

    A code b stands for the vector g = F'b, F being the directions. A vector is
    s*g plus a residual that is orthogonal to g; s and the residual's length are
    kept.
    """

    def __init__(self, vectors: np.ndarray, frame: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            signs = vectors @ frame.T >= 0
            stands = np.where(signs, 1.0, -1.0) @ frame
            self.square = (stands * stands).sum(axis=1)
            along = (vectors * stands).sum(axis=1)
            self.scale = along / self.square
            self.rest = np.sqrt(np.maximum((vectors * vectors).sum(axis=1) - along * self.scale, 0))
            # what rounding may hide
            self.rest += 1e-7 * np.sqrt((vectors * vectors).sum(axis=1))
        self.words = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1).astype(np.int64)

    def take(self, at: np.ndarray) -> Codes:
        out = object.__new__(Codes)
        for name in ("square", "scale", "rest", "words", "ones"):
            setattr(out, name, getattr(self, name)[at])
        return out


class Asked:
    """Queries in the codes' directions, rounded to PLANES bits a component and kept as planes of bits."""

    def __init__(self, vectors: np.ndarray, frame: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            turned = vectors @ frame.T
            self.bits = turned.shape[1]
            self.low = turned.min(axis=1)
            self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
            steps = np.nan_to_num(np.rint((turned - self.low[:, None]) / self.step[:, None])).astype(np.int64)
            self.sum = steps.sum(axis=1)
            self.off = np.abs(turned - self.low[:, None] - steps * self.step[:, None]).sum(axis=1) + 1e-7 * np.abs(turned).sum(axis=1)
            self.square = (vectors * vectors).sum(axis=1)
        self.planes = [np.packbits((steps >> p & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]

    def take(self, at: np.ndarray) -> Asked:
        out = object.__new__(Asked)
        out.bits, out.planes = self.bits, [p[at] for p in self.planes]
        for name in ("low", "step", "sum", "off", "square"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def intervals(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest values that the inner products of all queries and rows can have; not a number where one overflows."""
        common = np.zeros((len(self.low), len(codes.ones)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(plane.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & codes.words[None, :, w]).astype(np.int32) << p
        with np.errstate(over="ignore", invalid="ignore"):
            # <q, g> = <Fq, b>, within what rounding the query takes away
            met = self.low[:, None] * (2 * codes.ones - self.bits) + self.step[:, None] * (2.0 * common - self.sum[:, None])
            sure = np.maximum(np.abs(met) - self.off[:, None], 0)
            # Cauchy-Schwarz on the parts that are orthogonal to g
            across = np.sqrt(np.maximum(self.square[:, None] - sure * sure / codes.square, 0))
            wide = np.abs(codes.scale) * self.off[:, None] + across * codes.rest
            # of the product's own rounding
            wide += 1e-7 * (np.abs(met * codes.scale) + wide) + 1e-6
            return met * codes.scale - wide, met * codes.scale + wide


#: Ends of windows that are open.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _as_double(numbers: np.ndarray, towards: float) -> np.ndarray:
    """The numbers as doubles, rounded past them; ends that are open are infinite."""
    out = np.nextafter(numbers.astype(np.float64), towards)
    return np.where(numbers == (LEAST if towards < 0 else MOST), towards, out)


class Windows:
    """The k best scores within each window [low, high] so far, ties to the smaller id; a window is one of a query's."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        #: What a score must reach to be of use, and may reach, as doubles that leave nothing out.
        self.least, self.most = _as_double(low, -np.inf), _as_double(high, np.inf)
        self.w, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fits(self, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether scores lie in their windows, in whole numbers, and may be among the best."""
        low, high = self.low[w], self.high[w]
        inside = ((s >= low) | (low == LEAST)) & ((s <= high) | (high == MOST))
        return inside.astype(bool) & (as_doubles(s) >= self.least[w])
        self.w, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, w: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        if not len(w):
            return
        w, c, s = np.concatenate([self.w, w]), np.concatenate([self.c, c]), np.concatenate([self.s, s])
        order = np.lexsort((c, -order_of(s), w))
        w, c, s = w[order], c[order], s[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        best = nth < self.k
        self.w, self.c, self.s = w[best], c[best], s[best]
        last = np.flatnonzero(nth == self.k - 1)
        self.least[w[last]] = np.maximum(self.least[w[last]], np.nextafter(as_doubles(s[last]), -np.inf))


def _met(asked: Asked, codes: Codes, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, pairs: np.ndarray | None = None):
    """(query, row, score) of the pairs whose interval meets [least, most] of its query."""
    low, high = asked.intervals(codes)
    # what is not a number may be anything
    near = ~(high < least[:, None]) & ~(low > most[:, None])
    if pairs is not None:
        near &= pairs
    q, c = np.nonzero(near)
    return q, c, exact(queries, rows, q, c)


def coded(vectors: DataFrame) -> DataFrame:
    """The rows that take part, each vec_id once: (vec_id, label, v), v being doubles that are whole numbers."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "v"))
    return cut(kept.withColumn("nth", first).filter("nth = 1").drop("nth"))


CHUNK = "lane int, block int, kind int, seq int, ids binary, labels binary, width int, vectors binary, owner binary, low binary, high binary"
CHUNK_FIELDS = pa.schema(
    [(c, pa.int32()) for c in ("lane", "block", "kind", "seq")] + [(c, pa.binary()) for c in ("ids", "labels")] + [("width", pa.int32()), *((c, pa.binary()) for c in ("vectors", "owner", "low", "high"))]
)


def _packed(of: str, kind: int, dim: int):
    """Rows in chunks of one value of `of`, in the order in which they come; queries bring their windows along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        seq = 0

        def row(key: int) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            parts = held.pop(key)
            ids, labels, them = (np.concatenate([p[i] for p in parts]) for i in range(3))
            data, width = narrow(them)
            out = {"lane" if kind else "block": key, "kind": kind, "seq": seq, "ids": ids.tobytes(), "labels": labels.tobytes(), "width": width, "vectors": data}
            if not kind:
                counts, low, high = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
                out |= {"owner": np.repeat(np.arange(len(ids)), counts).tobytes(), "low": low.tobytes(), "high": high.tobytes()}
            return pa.RecordBatch.from_pylist([dict.fromkeys(CHUNK_FIELDS.names) | out], schema=CHUNK_FIELDS)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, labels, them = batch.column(of).to_numpy(), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), dim)
            windows = batch.column("windows").to_pylist() if not kind else None
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                part = [ids[at], labels[at], them[at]]
                if not kind:
                    mine = [windows[i] for i in at]
                    part.append(np.array([len(w) for w in mine], np.int64))
                    part += [np.array([x[end] for w in mine for x in w], np.int64) for end in ("low", "high")]
                held.setdefault(int(key), []).append(tuple(part))
                if sum(len(p[0]) for p in held[int(key)]) >= ROWS_AT_ONCE:
                    yield row(int(key))
        for key in list(held):
            yield row(key)

    return run


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int, same_label: bool, turns: int, query_block: int) -> DataFrame:
    """(query_id, window, vec_id, score, over): in each window of each query the k best rows of the same label, or of other labels.

    `asked` has vec_id, label, v and windows, an array of (low, high). Rows are
    dealt into lanes, queries into blocks; each block meets each lane in a task.
    """
    spark = rows.sparkSession
    n = asked.count()
    blocks, lanes = max(1, -(-n // query_block)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = spark.sparkContext.broadcast(directions(dim, turns))
    hashed = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(m)).cast("int")
    chunks = (
        rows.withColumn("lane", hashed(lanes)).repartition(lanes, "lane").sortWithinPartitions("lane", "label", "vec_id").select("lane", "vec_id", "label", "v").mapInArrow(_packed("lane", 1, dim), CHUNK)
    )
    queries = (
        asked.withColumn("block", hashed(blocks)).repartition(min(lanes, blocks), "block").sortWithinPartitions("block", "label", "vec_id")
        .select("block", "vec_id", "label", "v", "windows").mapInArrow(_packed("block", 0, dim), CHUNK)
    )
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    meet = chunks.withColumn("block", every(blocks)).unionByName(queries.withColumn("lane", every(lanes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, made = None, [], None

        def found(made) -> pa.RecordBatch:
            ids, windows, nth = made[0], made[4], made[5]
            score, over = in_64_bits(windows.s)
            owner = made[3][windows.w]
            return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(nth[windows.w]), pa.array(windows.c), pa.array(score), pa.array(over)], ["query_id", "window", "vec_id", "score", "over"])

        def prepared(parts):
            ids, labels, them, owner, low, high, base = [], [], [], [], [], [], 0
            for r in parts:
                ids.append(np.frombuffer(r["ids"], np.int64))
                labels.append(np.frombuffer(r["labels"], np.int64))
                them.append(widened(r["vectors"], r["width"], dim))
                owner.append(np.frombuffer(r["owner"], np.int64) + base)
                low.append(np.frombuffer(r["low"], np.int64))
                high.append(np.frombuffer(r["high"], np.int64))
                base += len(ids[-1])
            ids, labels, them, owner, low, high = (np.concatenate(x) for x in (ids, labels, them, owner, low, high))
            nth = (np.arange(len(owner)) - np.searchsorted(owner, owner)).astype(np.int32)
            return ids, labels, them, owner, Windows(low, high, k), nth, Asked(them, frame.value)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["lane"]) != now:
                    if made:
                        yield found(made)
                    now, parts, made = (r["block"], r["lane"]), [], None
                if r["kind"] == 0:
                    parts.append(r)
                elif parts:
                    made = made or prepared(parts)
                    _feed(made, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), widened(r["vectors"], r["width"], dim), frame.value, same_label)
        if made:
            yield found(made)

    dealt = meet.repartition(lanes, "block", "lane").sortWithinPartitions("block", "lane", "kind", "seq")
    return dealt.mapInArrow(run, "query_id long, window int, vec_id long, score long, over int")


def _feed(made, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, frame: np.ndarray, same_label: bool) -> None:
    """Compare a chunk of rows with all queries of a block."""
    q_ids, q_labels, queries, owner, windows, _, asked = made
    codes = Codes(rows, frame)
    if same_label:
        # labels are in order in the chunk: each label's queries meet its rows only
        order = np.argsort(q_labels, kind="stable")
        ranks = q_labels[order]
        tiles = [(order[np.searchsorted(ranks, x) : np.searchsorted(ranks, x, "right")], np.flatnonzero(labels == x)) for x in np.intersect1d(q_labels, labels)]
    else:
        tiles = [(np.arange(len(q_ids)), np.arange(len(ids)))]
    # each query has a window at least
    starts = np.searchsorted(owner, np.arange(len(q_ids)))
    ends = np.append(starts[1:], len(owner))
    for all_queries, at in tiles:
        part = codes if len(at) == len(ids) else codes.take(at)
        for i in range(0, len(all_queries), QUERIES_AT_ONCE):
            qs = all_queries[i : i + QUERIES_AT_ONCE]
            least, most = np.minimum.reduceat(windows.least, starts)[qs], np.maximum.reduceat(windows.most, starts)[qs]
            pairs = None if same_label else q_labels[qs][:, None] != labels[at][None, :]
            q, c, s = _met(asked.take(qs), part, queries[qs], rows[at], least, most, pairs)
            other = q_ids[qs[q]] != ids[at[c]]
            q, c, s = qs[q[other]], at[c[other]], s[other]
            for nth in range(int((ends[qs] - starts[qs]).max())):
                w = starts[q] + nth
                ok = np.flatnonzero(w < ends[q])
                ok = ok[windows.fits(w[ok], s[ok])]
                windows.add(w[ok], ids[c[ok]], s[ok])


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), turns: int = TURNS, query_block: int = 4096
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    `vectors` has vec_id, label and v, an array of whole numbers; anchors are
    the rows where is_anchor holds. An anchor's positives are the rows of its
    label with the highest inner products; the negatives of a positive are the
    rows of other labels with the highest scores from low to high times the
    positive's score. Ties go to the smaller vec_id, an anchor is not its own
    positive, and all are taken where there are fewer.

    Each row is kept as signs in rotated directions with how it lies to what
    they stand for; population counts with the rounded anchor estimate a score,
    and Cauchy-Schwarz on what is orthogonal to it gives an interval that holds
    for certain. Rows whose interval misses all that an anchor still looks for
    are skipped, all others are scored in whole numbers of any size. Two passes
    are made, for positives and for negatives.

    Rows with null vec_id, label or v take no part. Of rows of one vec_id the
    first by label and vector counts. Shorter vectors count as filled up with
    zeros. A positive whose score leaves 64 bits is an error. An empty table
    gives no rows; further columns are ignored.
    """
    rows = coded(vectors)
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    open_ = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    near = _search(rows, anchors.withColumn("windows", open_), dim, positives, True, turns, query_block)
    best = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id")
    within = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a positive's score leaves 64 bits: use a smaller scale")).cast("long"))
    held = cut(near.withColumn("nth", F.row_number().over(best) - 1).filter(F.col("nth") < positives).select("query_id", "nth", F.col("vec_id").alias("positive_id"), within.alias("positive_score")))
    # low * p <= score <= high * p, in whole numbers
    p = F.col("positive_score").cast("decimal(38,0)")
    floor = lambda n, d: ((n - F.pmod(n, F.lit(d).cast("decimal(38,0)"))) / d).cast("long")
    bounds = F.struct("nth", (-floor(-p * low[0], low[1])).alias("low"), floor(p * high[0], high[1]).alias("high"))
    listed = held.groupBy("query_id").agg(F.array_sort(F.collect_list(bounds)).alias("windows"))
    asked = cut(anchors.join(listed, F.col("vec_id") == F.col("query_id")).select("vec_id", "label", "v", "windows"))
    far = _search(rows, asked, dim, negatives, False, turns, query_block).filter("over = 0")
    nth = F.row_number().over(Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "vec_id"))
    ranked = far.withColumn("rank", nth).filter(F.col("rank") <= negatives)
    return ranked.join(held, (ranked["query_id"] == held["query_id"]) & (ranked["window"] == held["nth"])).select(
        ranked["query_id"].alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), whole(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


QUERIES = {"op11_negatives": op11_negatives}

SQL = {
    "op11_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM pairs WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS r
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 3
"""
}
