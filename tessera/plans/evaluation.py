"""Evaluation of retrieval and answers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import retrieve as R
from tessera.operators.holders import holders
from tessera.plans import texts
from tessera.plans.common import chunks, questions, saved, table
from tessera.plans.retrieval import BM25, UNITS, _asked, _top, _vectors
from tessera.functions import tokens

KS = (1, 3, 5, 10)


def _dense_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with the question's label are relevant; the grade is 2 for those of an even number."""
    asked, vectors = _asked(spark, sf_dir), _vectors(spark, sf_dir)
    qrels = asked.select("query_id", "label").join(vectors.select("chunk_id", "label"), "label").select("query_id", "chunk_id", (F.col("chunk_id") % 2 == 0).cast("double").alias("grade"))
    return R.dense(vectors, asked, 10), qrels.withColumn("grade", F.col("grade") + 1)


def dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.metrics(*_dense_run(spark, sf_dir), KS)
    return out.select("query_id", "n_relevant", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def dense_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(E.metrics(*_dense_run(spark, sf_dir), KS))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's whole text are relevant to it."""
    return saved(holders(chunks(spark, sf_dir), questions(spark, sf_dir)).withColumn("grade", F.lit(1.0)))


def bm25_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(E.metrics(R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 10), _planted(spark, sf_dir), KS))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question: the best document's text as the answer, the best three as sources, the question as the reference."""
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = R.bm25(rows, asked, 3).join(rows.select("chunk_id", "text"), "chunk_id")
    held = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("held"))
    return held.join(asked, "query_id").select(
        "query_id", F.col("query").alias("question"), F.element_at("held", -1)["text"].alias("answer"), F.col("query").alias("reference"), F.transform("held", lambda s: s["text"]).alias("sources")
    )


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.answer_metrics(_cases(spark, sf_dir))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers, grounded in the other documents that BM25 finds for their question."""
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = saved(R.bm25(rows, asked, 4).join(rows.select("chunk_id", "text"), "chunk_id"))
    answers = hits.filter("rank = 1").select(F.col("query_id").alias("answer_id"), F.col("text").alias("answer"))
    sources = hits.filter("rank > 1").select(F.col("query_id").alias("answer_id"), "chunk_id", "text")
    return E.grounding(answers, sources)


def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the grounding query, some with citations that there are sources for or not."""
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = saved(R.bm25(rows, asked, 4).join(rows.select("chunk_id", "text"), "chunk_id"))
    cited = F.when(F.col("query_id") % 3 == 0, F.concat("text", F.lit(" See [1] and [2-3]."))).when(F.col("query_id") % 3 == 1, F.concat("text", F.lit(" As in [2,9] it is."))).otherwise(F.col("text"))
    answers = hits.filter("rank = 1").select(F.col("query_id").alias("answer_id"), cited.alias("answer"))
    sources = hits.filter("rank > 1").select(F.col("query_id").alias("answer_id"), "chunk_id", "text")
    return E.grounding_report(answers, sources).withColumn("issues", F.array_join("issues", "; ")).withColumn("invalid_citations", F.array_join(F.transform("invalid_citations", lambda c: c.cast("string")), ","))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the dense run with the assistants' turns as answers, every third sentence end being a citation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.when(F.col("turn") % 4 == 1, F.replace("text", F.lit(". "), F.lit(" [1]. "))).otherwise(F.col("text"))
    answers = turns.select(F.col("conv_id").alias("query_id"), answer.alias("answer"), (F.length("text") / 7.0).alias("latency_ms"), tokens.quarter_tokens(F.col("text")).alias("tokens"))
    return E.evaluation_report(E.metrics(*_dense_run(spark, sf_dir), KS), answers)


def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns, some as refusals, as JSON or cut short."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.when(F.col("conv_id") % 5 == 1, F.concat(F.lit("I'm sorry, "), "text")).when(F.col("conv_id") % 5 == 2, F.concat(F.lit('{"a": "'), F.substring("text", 1, 40), F.lit('"}')))
    answer = answer.when(F.col("conv_id") % 5 == 3, F.substring("text", 1, 9)).otherwise(F.col("text"))
    issues = E.response_issues(answer)
    return turns.select("conv_id", "turn", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("valid"), E.admits_gap(answer).alias("gap"))


QUERIES = {
    "metrics_dense": dense_metrics,
    "metrics_dense_macro": dense_macro,
    "metrics_bm25_macro": bm25_macro,
    "answer_metrics": answer_metrics,
    "grounding": grounding,
    "response_checks": response_checks,
    "answer_report": answer_report,
    "evaluation_report": evaluation_report,
}


def _metrics_sql(run: str, qrels: str) -> str:
    per_k = ", ".join(
        f"coalesce(sum((r.rank <= {k})::INT), 0)::DOUBLE AS hits_{k}, coalesce(sum(CASE WHEN r.rank <= {k} THEN (pow(2.0, q.grade) - 1) / log2(r.rank + 1) END), 0) AS dcg_{k}, "
        f"sum(CASE WHEN q.place <= {k} THEN (pow(2.0, q.grade) - 1) / log2(q.place + 1) END) AS ideal_{k}"
        for k in KS
    )
    shown = ", ".join(f"hits_{k} / n AS recall_{k}, hits_{k} / {k} AS precision_{k}, dcg_{k} / ideal_{k} AS ndcg_{k}" for k in KS)
    return f"""
run AS ({run}), qrels AS ({qrels}),
q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS place FROM qrels),
r AS (SELECT run.*, row_number() OVER (PARTITION BY run.query_id ORDER BY run.rank) AS seen FROM run JOIN qrels ON run.query_id = qrels.query_id AND run.chunk_id = qrels.chunk_id),
m AS (SELECT q.query_id, count(*) AS n, {per_k}, coalesce(sum(r.seen::DOUBLE / r.rank), 0) AS s, coalesce(1.0::DOUBLE / min(r.rank), 0) AS rr FROM q LEFT JOIN r ON q.query_id = r.query_id AND q.chunk_id = r.chunk_id GROUP BY q.query_id),
per AS (SELECT query_id, n AS n_relevant, {shown}, s / n AS ap, rr FROM m)"""


_NAMES = [f"{m}_{k}" for k in KS for m in ("recall", "precision", "ndcg")] + ["ap", "rr"]
_MACRO = "SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _NAMES) + " FROM per"
_DENSE = _metrics_sql(
    f"SELECT query_id, chunk_id, rank FROM {_top('cosines', 10)}",
    "SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, CASE WHEN c.vec_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS grade FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id JOIN embeddings c ON q.label = c.label",
)
_PLANTED = _metrics_sql(
    f"SELECT query_id, chunk_id, rank FROM {_top('bm25', 10)}", "SELECT item_id AS query_id, doc_id AS chunk_id, 1.0 AS grade FROM documents d JOIN benchmark b ON contains(d.text, b.text)"
)
_METRIC = f"list_distinct({texts._content_sql(tokens.METRIC_STOPWORDS)})"

SQL = {
    "metrics_dense": f"WITH {UNITS}, {_DENSE} SELECT query_id, n_relevant, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM per",
    "metrics_dense_macro": f"WITH {UNITS}, {_DENSE} {_MACRO}",
    "metrics_bm25_macro": f"WITH {BM25}, {_PLANTED} {_MACRO}",
    "answer_metrics": f"""
WITH {BM25}, t AS (SELECT doc_id, {_METRIC} AS t FROM documents), h AS (SELECT b.*, t.t FROM {_top("bm25", 3)} b JOIN t ON b.chunk_id = t.doc_id),
c AS (SELECT query_id, max_by(t, rank) AS a, list(t) AS s, list_distinct(flatten(list(t))) AS every FROM h GROUP BY query_id),
q AS (SELECT item_id, {_METRIC} AS q FROM benchmark)
SELECT query_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, every))::DOUBLE / len(a) ELSE 0 END, 6) AS faithfulness,
  round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a))::DOUBLE / len(q) ELSE 0 END, 6) AS answer_relevancy,
  round(CASE WHEN len(a) > 0 THEN len(list_filter(s, lambda x: len(list_intersect(x, a))::DOUBLE / greatest(len(x), 1) >= 0.05))::DOUBLE / len(s) ELSE 0 END, 6) AS context_precision,
  round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, every))::DOUBLE / len(q) ELSE 0 END, 6) AS context_recall FROM c JOIN q ON c.query_id = q.item_id""",
    "response_checks": r"""
WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 THEN concat('I''m sorry, ', text) WHEN conv_id % 5 = 2 THEN concat('{"a": "', substr(text, 1, 40), '"}') WHEN conv_id % 5 = 3 THEN substr(text, 1, 9) ELSE text END AS t
  FROM conversations WHERE role = 'assistant'),
i AS (SELECT *, length(trim(t)) < 10 AS short, length(t) > 50000 AS long,
  regexp_matches(trim(t), '(?i)^I''m (sorry|unable|not able)') OR regexp_matches(trim(t), '(?i)^As an AI') OR regexp_matches(trim(t), '(?i)^I cannot (answer|complete|provide|fulfill)') OR regexp_matches(trim(t), '^\s*```') OR regexp_matches(trim(t), '^\s*\{.*\}\s*$') AS refused,
  len(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '')) AS n FROM a)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN short THEN 'too short' END, CASE WHEN long THEN 'too long' END, CASE WHEN refused THEN 'refusal' END, CASE WHEN n > 0 AND n < 3 THEN 'fewer than 3 words' END], lambda x: x IS NOT NULL), '; ') AS issues,
  NOT (short OR long OR refused OR (n > 0 AND n < 3)) AS valid,
  regexp_matches(lower(t), 'i don''t have enough information|i cannot answer|i don''t have the specific|i don''t have access to|not provided in the context|does not contain information|not mentioned in the sources|cannot find this information|the context does not|based on the provided context, i cannot') AS gap FROM i""",
    "evaluation_report": f"""
WITH {UNITS}, {_DENSE}, means AS ({_MACRO}), turns AS (SELECT text, CASE WHEN turn % 4 = 1 THEN replace(text, '. ', ' [1]. ') ELSE text END AS a FROM conversations WHERE role = 'assistant'),
parts AS (SELECT length(text) / 7.0::DOUBLE AS latency, length(text) // 4 AS n, list_filter(list_transform(string_split(regexp_replace(a, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 10) AS p FROM turns),
said AS (SELECT count(*) AS n_answers, round(avg(latency), 2) AS latency_ms, round(avg(n), 1) AS tokens,
  round(avg(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: regexp_matches(x, '\\[[0-9]+\\]')))::DOUBLE / len(p) ELSE 0 END), 4) AS citation_coverage FROM parts)
SELECT * FROM means, said""",
}
