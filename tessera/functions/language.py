"""The language of a text by its groups of three characters: a naive Bayes model that is fitted and applied on Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Groups of three characters fall into so many buckets.
BUCKETS = 1 << 16
#: What each bucket counts beforehand.
SMOOTH = 0.5
#: Texts of fewer characters have no language of their own.
LEAST = 20


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each group of three characters of all texts, and whose it is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[2:] == owner[:-2]
    return ((codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % BUCKETS)[inside], owner[:-2][inside]


@dataclass
class LanguageModel:
    """Languages in order, and for each bucket and language the logarithm of its share."""

    languages: list[str]
    weights: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
        """From all rows that have a text and a language: each task counts, and one row a language and task is added up.

        Languages are bounded by their number, counts by BUCKETS; a table
        without rows gives a model that knows no language.
        """
        given = rows.filter(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.lower(text).alias("text"), F.col(language).cast("string").alias("lang"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                names = np.array(batch.column("lang").to_pylist(), object)
                for i in range(0, batch.num_rows, 256):
                    bucket, owner = buckets(batch.column("text").slice(i, 256).to_pylist())
                    of = names[i : i + 256][owner]
                    for name in set(names[i : i + 256]):
                        held[name] = held.get(name, 0) + np.bincount(bucket[of == name], minlength=BUCKETS)
            yield from _rows(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    held[r["lang"]] = held.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
            yield from _rows(held)

        schema = "lang string, counts binary"
        counted = given.mapInArrow(count, schema)
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # in two steps: some tasks add up others' rows, then one task each language
        dealt = counted.repartition(tasks, "lang", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, schema)
        sums = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in dealt.repartition(tasks, "lang").mapInArrow(add, schema).collect()}
        names = sorted(sums)
        counts = np.array([sums[n] for n in names], float).reshape(len(names), BUCKETS)
        return LanguageModel(names, np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).T.copy())

    def scores(self, texts: list[str]) -> np.ndarray:
        """The logarithm of each text's likelihood in each language."""
        bucket, owner = buckets(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, self.weights[bucket, j], len(texts))
        return out

    def detect(self, spark, least: int = LEAST):
        """A column function: (language, share) of a text, all languages being as likely beforehand; en and 0.5 for null and short texts."""
        model = spark.sparkContext.broadcast(self)
        kind = StructType([StructField("language", StringType()), StructField("share", DoubleType())])

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            them, m = [t or "" for t in texts.to_pylist()], model.value
            names, shares = [], []
            for i in range(0, len(them), 256):
                part = them[i : i + 256]
                if not m.languages:
                    names, shares = names + ["en"] * len(part), shares + [0.5] * len(part)
                    continue
                got = m.scores(part)
                best = got.argmax(axis=1)
                share = 1 / np.exp(got - got.max(axis=1, keepdims=True)).sum(axis=1)
                short = [len(t) < least for t in part]
                names += ["en" if s else m.languages[b] for s, b in zip(short, best, strict=True)]
                shares += [0.5 if s else round(float(x), 4) for s, x in zip(short, share, strict=True)]
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["language", "share"])

        return lambda text: run(F.lower(text))


def _rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in held.items():
        yield pa.RecordBatch.from_pylist([{"lang": name, "counts": counts.tobytes()}], schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))


def long_lines(text: Column, least: int = 50) -> Column:
    """The lines of a text, trimmed, that are long enough to have a language."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def by_line(rows: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """(key, language, n, share): the languages of a text's long lines, and which share of these each has."""
    found = rows.select(key, F.explode(long_lines(F.col(text), least)).alias("line"))
    told = found.select(key, model.detect(rows.sparkSession)(F.col("line")).alias("d")).groupBy(key, F.col("d.language").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    total = told.groupBy(key).agg(F.sum("n").alias("total"))
    return told.join(total, key).select(key, "language", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
