"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, strings, table

#: Labelled documents that the models are fitted on, at most: those of the least hash of doc_id.
MOST_LABELLED = 8000
#: With fewer, or without both toxic and other ones among them, nothing is fitted and nothing is rejected.
LEAST_LABELLED = 20
#: Features that the models use, at most, and documents of the sample that a feature must occur in.
MOST_FEATURES, LEAST_DOCS = 4096, 6
#: Chi-square that a feature must have for some category: about one in ten thousand of the others has it by chance.
LEAST_CHI_SQUARE = 15.0
#: ASCII that is neither letter nor digit separates words.
SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
PREFIX = 6


def features(text: str) -> set[bytes]:
    """The text's lower-case words, and a '^' and the first bytes of the longer ones."""
    words = set(text.lower().encode("utf-8", "replace").translate(SPLIT).split())
    return words | {b"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


@dataclass
class Chain:
    """weights[i] has one weight for each feature, one for each earlier category's log odds, and the constant."""

    categories: tuple[str, ...]
    index: dict[bytes, int]
    weights: list[np.ndarray]
    threshold: float

    def probabilities(self, text: str) -> list[float]:
        at = [i for f in features(text) & self.index.keys() for i in (self.index[f],)]
        out: list[float] = []
        for w in self.weights:
            n = len(self.index)
            z = w[at].sum() + w[-1] + sum(w[n + j] * log_odds(p) for j, p in enumerate(out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def log_odds(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, n: int, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on set features (rows, cols) and dense columns, by adaptive gradient steps.

    A feature counts by the logarithm of how much likelier it is in one class
    than in the other, so that the penalty bears on what tells little.
    """
    inside = np.bincount(cols, y[rows], n)
    outside = np.bincount(cols, minlength=n) - inside
    ratio = np.log((inside + 0.5) / (y.sum() + 1)) - np.log((outside + 0.5) / (len(y) - y.sum() + 1))
    w = np.zeros(n + extra.shape[1] + 1)
    w[-1] = log_odds(y.mean())
    seen = np.full_like(w, 1e-8)
    for _ in range(steps):
        z = np.bincount(rows, (w[:n] * ratio)[cols], len(y)) + extra @ w[n:-1] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(cols, error[rows], n) * ratio, extra.T @ error, [error.sum()]]) / len(y)
        grad[:-1] += penalty * w[:-1]
        seen += grad**2
        w -= 0.3 * grad / np.sqrt(seen)
    w[:n] *= ratio
    return w


def fit_chain(categories: tuple[str, ...], vocabulary: list[bytes], found: list[list[int]], labels: np.ndarray, folds: int = 4) -> Chain:
    """Each category's model sees the earlier ones' log odds; in training these come from models that did not see the document."""
    n, m = len(vocabulary), len(found)
    rows = np.repeat(np.arange(m), [len(x) for x in found])
    cols = np.fromiter((i for x in found for i in x), np.int64, len(rows))
    fold = np.arange(m) % folds
    extra, weights, held = np.zeros((m, 0)), [], np.zeros(m)
    for y in labels.T:
        held = np.zeros(m)
        for k in range(folds):
            own = fold == k
            rest = ~own
            place = np.cumsum(rest) - 1
            pick = rest[rows]
            w = logistic(place[rows[pick]], cols[pick], extra[rest], y[rest], n)
            z = np.bincount(rows, w[cols], m) + extra @ w[n:-1] + w[-1]
            held[own] = 1 / (1 + np.exp(-np.clip(z[own], -30, 30)))
        weights.append(logistic(rows, cols, extra, y, n))
        extra = np.column_stack([extra, log_odds(held)])
    return Chain(categories, {f: i for i, f in enumerate(vocabulary)}, weights, best_threshold(held, labels[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is largest on the held-out probabilities, from 0.05 to 0.95; 0.5 if there is nothing to find."""
    if not y.any():
        return 0.5
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    # only between different probabilities
    apart = np.append(np.diff(p[order]) < 0, True)
    k = int(np.argmax(np.where(apart, f1, -1)))
    middle = (p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2
    return float(np.clip(middle, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], most: int = MOST_LABELLED) -> Chain | None:
    """A chain for 0/1 columns of `labels`, in their order; the last decides. None if too few labelled documents are there.

    Fitted on `most` labelled documents at most, those of the least hash of
    doc_id. Features are the MOST_FEATURES that tell any category best
    (chi-square, ties by the feature) among those in LEAST_DOCS or more.

    A null label is 0, null text is empty; labels or documents without doc_id
    take no part. Of a doc_id's several labels the highest of each category
    counts, of its several texts the least: the chain is the same on each run.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in categories))
        .filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(*(F.max(c).alias(c) for c in categories))
    )
    picked = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = cut(labelled.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in categories)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(len(categories) + 1)]
        for batch in batches:
            of = [batch.column(c).to_pylist() for c in categories]
            for i, text in enumerate(strings(batch.column("text"))):
                own = features(text)
                counts[0].update(own)
                for c, y in zip(counts[1:], of, strict=True):
                    if y[i]:
                        c.update(own)
        keys = list(counts[0])
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([c[k] for k in part], pa.int64()) for c in counts)], names)

    names = ["feature", "n", *(f"n_{c}" for c in categories)]
    totals = sample.agg(F.count(F.lit(1)), *(F.sum(c) for c in categories)).first()
    m = totals[0]
    if m < LEAST_LABELLED or not 0 < (totals[len(categories)] or 0) < m:
        return None
    counted = sample.mapInArrow(count, "feature binary, " + ", ".join(f"{c} long" for c in names[1:])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[1:]))

    def chi_square(c: str, positive: int):
        a, n = F.col(f"n_{c}").cast("double"), F.col("n").cast("double")
        expected = n * positive / m
        spread = expected * (1 - positive / m) * (1 - n / m)
        return F.when(spread > 0, (a - expected) ** 2 / spread).otherwise(0.0)

    told = F.greatest(*(chi_square(c, p or 0) for c, p in zip(categories, totals[1:], strict=True)), F.lit(0.0))
    best = counted.filter((F.col("n") >= LEAST_DOCS) & (told >= LEAST_CHI_SQUARE)).orderBy(F.round(told, 6).desc(), "feature").limit(MOST_FEATURES)
    vocabulary = sorted(bytes(r["feature"]) for r in best.select("feature").collect())
    index = {f: i for i, f in enumerate(vocabulary)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(index[f] for f in features(text) & index.keys()) for text in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at, pa.list_(pa.int32())), *(batch.column(c) for c in categories)], ["doc_id", "at", *categories])

    rows = sample.mapInArrow(look_up, "doc_id long, at array<int>, " + ", ".join(f"{c} int" for c in categories)).toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return fit_chain(categories, vocabulary, [r["at"] for r in rows], np.array([[r[c] for c in categories] for r in rows], float))


def score_toxicity(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...]) -> DataFrame:
    """(doc_id, one probability p_<category> each, toxic): toxic if the last category's reaches the chain's threshold.

    Null text counts as empty; doc_id may be null or repeated; one row a
    document; an empty table gives no rows; further columns are ignored.
    Without a chain nothing is toxic and all probabilities are 0.
    """
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [chain.probabilities(t) if chain else [0.0] * len(categories) for t in strings(batch.column("text"))]
            p = [pa.array(x, pa.float64()) for x in zip(*found, strict=True)]
            toxic = pa.array([bool(chain) and x[-1] >= chain.threshold for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *p, toxic], ["doc_id", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean")


def reject_toxic(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The documents that are not toxic, with all their columns; nothing is moved.

    Each row is judged by its own text, null being empty; null and repeated
    doc_ids change nothing; an empty table stays empty; all columns stay,
    whatever their names. Without a chain all documents stay.
    """
    if chain is None:
        return docs
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep = [chain.probabilities(t)[-1] < chain.threshold for t in strings(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


#: The labels' columns in the order of the chain: what is written badly is more often toxic.
CATEGORIES = ("low_quality", "toxic")


def categories_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, categories_of(table(spark, sf_dir, "labels")), CATEGORIES)
    found = score_toxicity(docs, chain, CATEGORIES)
    return found.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), "toxic")


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
