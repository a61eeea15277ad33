"""A training corpus in five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, secrets, simhash, toxicity
from tessera.llm.common import cut, free_names, named, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, with their columns as they are.

    Each row is judged by its own text, null being empty; null and repeated
    doc_ids stay like others. Without labelled documents, or if these are of
    one class only, nothing is rejected; an empty table stays empty.
    """
    labels = toxicity.categories_of(table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels, toxicity.CATEGORIES))


#: Texts are copies if their fingerprints differ by so many bits at most, or if their sets of shingles of five words have this Jaccard similarity.
RADIUS, WORDS, SIMILARITY = 3, 5, 0.8


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that of the least doc_id, null being last.

    Rows are judged by their own texts, also where they share a doc_id; rows
    that repeat doc_id and text are one. Texts without words, null among them,
    are copies of each other. An empty table stays empty; columns stay as they
    are, whatever their names.
    """
    return simhash.one_of_each_class(docs, WORDS, SIMILARITY, RADIUS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged by their own texts: a null doc_id, or one that other rows
    have too, changes nothing. Without items all documents stay; an empty table
    stays empty; columns stay as they are, whatever their names.
    """
    (key,) = free_names(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    held = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark"))
    found = cut(held.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(found, key, "left_anti").select(*(named(c) for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, if there, put right; null texts stay null, and an empty table empty."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a random order.

    Null is a source like others; columns named copy and shuffle_key are
    replaced, all others stay; an empty table gives no rows.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: SQL cannot express the classifiers' stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
