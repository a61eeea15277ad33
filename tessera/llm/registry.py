"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, html, lexical, licenses, mixing, negatives, pii, secrets, simhash, suffixes, topk, toxicity

MODULES = (decontaminate, topk, suffixes, pii, html, toxicity, secrets, chat, mixing, simhash, negatives, lexical, licenses)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
