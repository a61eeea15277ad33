"""Ranked lexical search: sums of short lists are made first, then walked with the long lists document by document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table, utf8

#: Letters and digits, A-Z lower-cased, and all bytes of other characters; what is between terms becomes a space.
AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Items are searched for in blocks of so many bytes, or one item: a block's terms go to every task.
BLOCK_BYTES = 16_000_000
#: A segment of the index ends with the row that takes it over so many bytes of text.
SEGMENT_BYTES = 16_000_000
#: Documents that a long list can skip at once.
SKIP = 64
#: So many runs of documents are looked at before the bound is renewed.
RUNS = 16
#: In a segment a list is long if it has more than this share of its documents.
LONG = 1 / 8
SAFE = 1 << 62


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(AS_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each posting adds to a score, in whole numbers: term count, length of its document, weight of its term."""
    if 75 * n * int(lengths.max(initial=0)) >= SAFE:
        share = np.array([75 * int(x) * n // total for x in lengths], np.int64)
    else:
        share = 75 * lengths * n // max(total, 1)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * (25 + share)))


class Best:
    """The k best documents of an item so far, in order of score and then of id, null being the last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: What a score must reach; one equal to the last kept may have a smaller id.
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]
        if len(best) == self.k:
            self.least = max(1, int(self.scores[-1]))


class Segment:
    """The postings of some documents, by term: short lists as they are, long ones with a place for each document and the maxima of runs."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, docs: np.ndarray, terms: np.ndarray, add: np.ndarray, n_terms: int):
        self.ids, self.null = ids, null
        self.n = len(ids)
        self.runs = -(-self.n // SKIP)
        order = np.argsort(terms, kind="stable")
        self.docs, self.add, terms = docs[order], add[order], terms[order]
        self.start = np.searchsorted(terms, np.arange(n_terms + 1))
        count = np.diff(self.start)
        long = np.flatnonzero(count > LONG * self.n)
        self.row = np.full(n_terms, -1)
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.runs * SKIP), np.int64)
        for r, t in enumerate(long):
            at = slice(self.start[t], self.start[t + 1])
            self.dense[r, self.docs[at]] = self.add[at]
        self.most = self.dense.reshape(len(long), self.runs, SKIP).max(axis=2, initial=0)
        self.read = self.skipped = 0

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Walk the documents for an item: its terms and how often each is in it."""
        rows = self.row[terms]
        long, short = rows >= 0, rows < 0
        # term at a time: the short lists become one list of sums
        parts = [(slice(self.start[t], self.start[t + 1]), m) for t, m in zip(terms[short], times[short], strict=True) if self.start[t + 1] > self.start[t]]
        sums = np.zeros(self.runs * SKIP, np.int64)
        for at, m in parts:
            # a document is in a list once
            sums[self.docs[at]] += self.add[at] * m
        rows, m = rows[long], times[long]
        # document at a time: a run is looked at where the maxima of all lists together reach the bound
        summed = sums.reshape(self.runs, SKIP)
        bound = summed.max(axis=1) + m @ self.most[rows]
        # the lists that matter most come first, so that what is left to come is little
        order = np.argsort(-self.most[rows].max(axis=1, initial=0) * m, kind="stable")
        rows, m = rows[order], m[order]
        open_ = np.flatnonzero(bound >= best.least)
        self.skipped += self.runs
        for i in range(0, len(open_), RUNS):
            runs = open_[i : i + RUNS]
            runs = runs[bound[runs] >= best.least]
            if not len(runs):
                continue
            self.read, self.skipped = self.read + len(runs), self.skipped - len(runs)
            docs = (runs[:, None] * SKIP + np.arange(SKIP)).ravel()
            score = sums[docs]
            left = bound[runs].repeat(SKIP) - summed.max(axis=1)[runs].repeat(SKIP)
            for r, x in zip(rows, m, strict=True):
                score = score + self.dense[r, docs] * x
                left = left - self.most[r, docs // SKIP] * x
                # what is seen and the most that can follow
                may = score + left >= best.least
                if np.count_nonzero(may) * 2 < len(docs):
                    docs, score, left = docs[may], score[may], left[may]
            hit = score >= best.least
            if hit.any():
                docs = docs[hit]
                best.add(score[hit], self.ids[docs], self.null[docs])


#: kind 0: postings of a segment; kind 1: of a task, documents and terms in all, and in how many documents each term is.
PACKED = "kind int, n long, total long, ids binary, null binary, lengths binary, docs binary, terms binary, tfs binary, df binary"
FIELDS = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), *((c, pa.binary()) for c in ("ids", "null", "lengths", "docs", "terms", "tfs", "df"))])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict.fromkeys(FIELDS.names) | values], schema=FIELDS)


def _index(vocabulary: dict[bytes, int], segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        df = np.zeros(len(vocabulary), np.int64)
        n = total = 0
        held: list[tuple] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids, null, lengths, terms, tfs = zip(*held, strict=True)
            docs = np.repeat(np.arange(len(held)), [len(x) for x in terms])
            out = {"ids": np.array(ids, np.int64), "null": np.array(null, bool), "lengths": np.array(lengths, np.int64)}
            out |= {"docs": docs.astype(np.int32), "terms": np.concatenate(terms).astype(np.int32), "tfs": np.concatenate(tfs).astype(np.int32)}
            held.clear()
            return _row(kind=0, **{k: v.tobytes() for k, v in out.items()})

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, text in zip(ids, utf8(batch.column("text")), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                n, total = n + 1, total + len(found)
                counts = Counter(found)
                mine = [t for t in counts if t in known]
                if not mine:
                    continue
                terms = np.array([vocabulary[t] for t in mine], np.int64)
                df[terms] += 1
                held.append((i or 0, i is None, len(found), terms, np.array([counts[t] for t in mine], np.int64)))
                # rows of little text have postings all the same
                size += len(text) + 64
                if size > segment_bytes:
                    yield segment()
                    size = 0
        if held:
            yield segment()
        if n:
            yield _row(kind=1, n=n, total=total, df=df.tobytes())

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a task's sums."""
    n = total = 0
    df = None
    for batch in batches:
        for r in batch.to_pylist():
            n, total = n + r["n"], total + r["total"]
            mine = np.frombuffer(r["df"], np.int64)
            df = mine.copy() if df is None else df + mine
    if df is not None:
        yield pa.RecordBatch.from_pylist([{"n": n, "total": total, "df": df.tobytes()}], schema=pa.schema([("n", pa.int64()), ("total", pa.int64()), ("df", pa.binary())]))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks; no more than one is on the driver."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        counts = Counter(terms_of((r["text"] or "").encode()))
        if counts:
            held.append((r["item_id"], counts))
            size += sum(len(t) + 64 for t in counts)
            if size > block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES, counted: bool = False
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item, ties to the smaller doc_id.

    Terms are runs of letters, digits and characters beyond ASCII in whole
    texts. One pass over the documents packs the postings of the items' terms
    into segments, which stay in the partition of their rows, and adds up what
    scores need: documents, terms in all, documents of each term. Then each task
    walks its own segments for all items, with the k best of each so far, and
    only these are sent. In a segment the sums of short lists are made term at a
    time and count as one list; with the long lists it is walked in runs of
    documents, and skipped where the maxima of its lists cannot reach an item's
    k-th best. Items come in blocks of bounded size, each with a pass of its own.

    Each row of docs is a document: rows of one doc_id are ranked each for
    itself, a null doc_id comes last among equals. Null texts have no terms, and
    documents without terms count nowhere. Both ids are whole numbers. Items without terms, and those that
    no document fits, have no rows; items of one id are ranked each for itself
    under that id. Further columns are ignored. A text is one row in a task,
    whatever its length. `counted` gives (read, skipped) runs of documents for
    each task and segment instead.
    """
    spark = docs.sparkSession
    out, asked = None, 0
    for block in _blocks(items, block_bytes):
        found = _search_block(docs, block, asked, k, segment_bytes, counted)
        out, asked = found if out is None else out.unionByName(found), asked + len(block)
    if out is None:
        kinds = (items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
        return spark.createDataFrame([], "read long, skipped long" if counted else "item_id {}, rank int, doc_id {}, score long".format(*kinds))
    if counted:
        return out
    window = Window.partitionBy("place", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType), "score")


def _search_block(docs: DataFrame, block: list[tuple], before: int, k: int, segment_bytes: int, counted: bool) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = cut(rows.mapInArrow(_index(vocabulary, segment_bytes), PACKED))
    sums = index.filter("kind = 1").select("n", "total", "df")
    # a row for each task, then a row for each of a few: what comes to the driver is some rows of the vocabulary's size
    few = max(1, int(sums.count() ** 0.5))
    for wide in (few, 1):
        sums = sums.repartition(wide).mapInArrow(_added, "n long, total long, df binary")
    first = sums.first()
    n, total = (first["n"], first["total"]) if first else (0, 0)
    df = np.frombuffer(first["df"], np.int64) if first else np.zeros(len(vocabulary), np.int64)
    weights = np.array([weight(n, int(x)) if x else 0 for x in df], np.int64)
    asked = [
        (place, i, np.array([vocabulary[t] for t in counts if df[vocabulary[t]]], np.int64), np.array([x for t, x in counts.items() if df[vocabulary[t]]], np.int64))
        for place, (i, counts) in enumerate(block, before)
    ]
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        read = skipped = 0
        for batch in batches:
            for r in batch.to_pylist():
                get = lambda name, kind: np.frombuffer(r[name], kind)  # noqa: B023, E731
                docs, terms, lengths = get("docs", np.int32), get("terms", np.int32), get("lengths", np.int64)
                add = impacts(get("tfs", np.int32).astype(np.int64), lengths[docs], weights[terms], n, total)
                segment = Segment(get("ids", np.int64), get("null", bool), docs, terms, add, len(weights))
                for (_, _, ts, times), b in zip(asked, best, strict=True):
                    segment.search(ts, times, b)
                read, skipped = read + segment.read, skipped + segment.skipped
        if counted:
            yield pa.RecordBatch.from_pylist([{"read": read, "skipped": skipped}], schema=pa.schema([("read", pa.int64()), ("skipped", pa.int64())]))
            return
        for (place, item, _, _), b in zip(asked, best, strict=True):
            if len(b.ids):
                m = len(b.ids)
                ids = pa.array(b.ids, mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array([place] * m, pa.int64()), pa.array([item] * m, pa.int64()), ids, pa.array(b.scores)], ["place", "item_id", "doc_id", "score"])

    schema = "read long, skipped long" if counted else "place long, item_id long, doc_id long, score long"
    return index.filter("kind = 0").select(*[c for c in FIELDS.names if c not in ("df", "n", "total")]).mapInArrow(run, schema)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical": op12_lexical}

TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = {
    "op12_lexical": f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
stats AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
parts AS (
  SELECT item_id, doc_id, times * floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * len * n) // total)))) AS part
  FROM asked JOIN dfs USING (term) JOIN post USING (term), stats
), scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INT AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
}
