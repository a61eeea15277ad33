"""Whole documents in chunks, by every strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chunk
from tessera.functions.tokens import sentences
from tessera.plans.common import table

#: Between the lines of a document, so that there are headings, tables and code to cut at.
MARKS = {
    "semantic": None,
    "adaptive": "\n\n- one\n- two\n\n",
    "ocr": None,
    "heading": "\n## Part\n\n| a | b |\n",
    "markdown": "\n# Head\n```\n# not a head\n```\n",
    "table_aware": "\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "code": "\n\ndef f():\n    return 1\n\nclass A:\n    pass\n\n",
}


def _marked(name: str) -> Column:
    return F.col("text") if MARKS[name] is None else F.concat(F.lit("# Top\n"), F.replace("text", F.lit("\n"), F.lit(MARKS[name])))


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", _marked(name).alias("text"))
        out = chunk.chunk_documents(docs, name)
        return out.select("doc_id", "chunk_index", "chunk_type", "section_title", F.array_join("section_hierarchy", "/").alias("path"), "char_count", "token_count", "content_checksum")

    return run


def auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of file by source; each is chunked by its strategy."""
    types = F.create_map(F.lit("src1"), F.lit("text/markdown"), F.lit("src2"), F.lit("text/csv"), F.lit("src3"), F.lit("application/pdf"), F.lit("src4"), F.lit("application/json"), F.lit("src5"), F.lit("text/html"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.try_element_at(types, F.col("source")).alias("mime"))
    return chunk.chunk_documents(docs, mime="mime").select("doc_id", "chunk_index", "chunk_type", "char_count", "content_checksum")


def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.parent_child(_marked("heading"))).alias("chunk_index", "c"))
    return docs.select("doc_id", "chunk_index", "c.chunk_type", "c.parent", F.length("c.content").alias("char_count"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(sentences(F.col("text"))).alias("n_sentences"))


QUERIES = {f"chunk_{name}": _query(name) for name in MARKS} | {"chunk_auto": auto, "chunk_parent_child": parent_child, "sentences": sentence_counts}

#: The other chunkers need look-behind or folds; tests hold them against plain models.
SQL = {
    "chunk_table_aware": r"""
WITH m AS (SELECT doc_id, concat('# Top', chr(10), replace(text, chr(10), concat(chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10)))) AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m),
k AS (SELECT *, regexp_matches(line, '^\s*\|.+\|\s*$') AS is_table FROM l),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, is_table ORDER BY i) AS run FROM k),
c AS (SELECT doc_id, is_table, min(i) AS i, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS content FROM r GROUP BY doc_id, is_table, run),
f AS (SELECT *, count(*) FILTER (WHERE length(content) >= 100) OVER (PARTITION BY doc_id) AS n_long FROM c WHERE content <> '' AND (is_table OR length(content) >= 100))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, CASE WHEN is_table THEN 'table' ELSE 'text' END AS chunk_type, NULL AS section_title, '' AS path,
  length(content)::INT AS char_count, (length(content) // 4)::INT AS token_count, substr(sha256(content), 1, 16) AS content_checksum FROM f WHERE n_long = 0 OR length(content) >= 100""",
}
