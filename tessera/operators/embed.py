"""Embedding through a provider, with cache, checks and failures per row."""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import CACHE_KEY, cache_lookup, text_errors, vector_errors

Provider = Callable[[list[str]], list[list[float]]]
BATCH = 32


def hashing_provider(dimension: int = 64) -> Provider:
    """A stand-in that needs no model: signed counts of hashed words, of length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


class Transient(Exception):
    """A provider's failure that may pass: no connection, a time-out, too many requests (`limited`)."""

    def __init__(self, said: str, limited: bool = False):
        super().__init__(said)
        self.limited = limited


def with_retries(provider: Provider, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> Provider:
    """The provider, called again after failures that may pass: after 1, 2, 4 ... seconds and up to a fifth more (30 at most),
    twice as long (60 at most) where there were too many requests. Other failures are not tried again."""

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                return provider(texts)
            except Transient as e:
                if attempt == retries:
                    raise
                pause = 2.0**attempt * (1 + 0.2 * random.random())
                wait(min(60.0, 2 * pause) if e.limited else min(30.0, pause))
        raise AssertionError("the last attempt returns or raises")

    return call


def batch_errors(chunks: DataFrame, most_tokens: int = 8192) -> DataFrame:
    """(chunk_id, error) of inputs that cannot be embedded: empty, longer than four characters a token, or a chunk_id that is there twice."""
    text = F.col("text")
    bad = F.when(text.isNull() | (F.trim(text) == ""), "blank").when(F.length(text) > 4 * most_tokens, "too long")
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id", F.lit("repeated id").alias("error"))
    return chunks.select("chunk_id", bad.alias("error")).filter("error IS NOT NULL").unionByName(twice)


def embed(chunks: DataFrame, provider: Provider, dimension: int, batch: int = BATCH) -> DataFrame:
    """(chunk_id, vector, error): one vector for each text; a failed batch marks its own rows only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            errors: list = []
            for i in range(0, len(frame), batch):
                texts = frame["text"].iloc[i : i + batch].tolist()
                try:
                    got = provider(texts)
                    vectors += got
                    errors += [None] * len(texts)
                except Exception as e:  # the provider is another system; what it says is kept with the rows
                    vectors += [None] * len(texts)
                    errors += [str(e)[:200]] * len(texts)
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "vector": vectors, "error": errors})

    checked = chunks.select("chunk_id", "text", text_errors(F.col("text"), 1 << 30).alias("_bad"))
    good = checked.filter("_bad IS NULL").select("chunk_id", "text").mapInPandas(run, "chunk_id long, vector array<double>, error string")
    good = good.withColumn("error", F.coalesce("error", vector_errors(F.col("vector"), dimension)))
    bad = checked.filter("_bad IS NOT NULL").select("chunk_id", F.lit(None).cast("array<double>").alias("vector"), F.col("_bad").alias("error"))
    return good.unionByName(bad)


def index_chunks(chunks: DataFrame, cache: DataFrame, provider: Provider, model: str, dimension: int, now) -> DataFrame:
    """(chunk_id, checksum, vector, cached, error) of all chunks: each content is embedded once, and only if the cache lacks it.

    A chunk without text has no checksum and the error "blank".
    """
    empty = chunks.filter("text IS NULL").select("chunk_id", F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("array<double>").alias("vector"), F.lit(False).alias("cached"), F.lit("blank").alias("error"))
    wanted = chunks.filter("text IS NOT NULL").withColumn("checksum", F.sha2("text", 256)).withColumn("model", F.lit(model)).withColumn("dimension", F.lit(dimension))
    hits, misses = cache_lookup(wanted, cache, now)
    contents = misses.groupBy(*CACHE_KEY).agg(F.min("chunk_id").alias("chunk_id"), F.first("text").alias("text"))
    made = embed(contents.select("chunk_id", "text"), provider, dimension).join(contents.select("chunk_id", "checksum"), "chunk_id").drop("chunk_id")
    fresh = misses.join(made, "checksum").select("chunk_id", "checksum", "vector", F.lit(False).alias("cached"), "error")
    return hits.select("chunk_id", "checksum", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")).unionByName(fresh).unionByName(empty)
