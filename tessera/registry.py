"""All queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import chunking, composite, contexts, evaluation, extraction, lifecycle, prompting, queries as question_plans, relational, retrieval, streams, texts

MODULES = (texts, extraction, chunking, question_plans, retrieval, contexts, evaluation, relational, streams, composite, prompting, lifecycle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)
