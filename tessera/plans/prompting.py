"""Prompts, key terms, late interaction and approximate search over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder
from tessera.operators import ann, prompts
from tessera.operators import context as C
from tessera.operators import retrieve as R
from tessera.operators.products import late_interaction as late_interaction_best
from tessera.plans.common import table
from tessera.plans.contexts import _HITS, _hits
from tessera.plans.retrieval import UNITS, _asked, _top, _vectors

SYSTEM = "Answer from the sources and cite them by number."
MODELS = ("meta/llama-3.1-8b-instruct", "GPT-4o-mini", "mistralai/mistral-large-2", "other")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation: its last turns within a budget as history, its first text as context, its last one as question."""
    turns = table(spark, sf_dir, "conversations")
    kept = C.history(turns, 400).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    ends = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("question"))
    both = ends.join(kept, "conv_id", "left")
    said = prompts.messages(SYSTEM, F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), F.when(F.col("conv_id") % 3 > 0, F.col("first")), F.col("question"))
    out = both.select("conv_id", said.alias("m"))
    return out.select("conv_id", F.size("m").alias("n_messages"), prompts.message_tokens(F.col("m")).alias("n_tokens"), F.md5(F.array_join(F.transform("m", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").cast("binary")).alias("digest"))


def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(prompts.key_terms(F.col("text")), " ").alias("terms"))


def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % len(MODELS) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(name.alias("model"), prompts.context_limit(name).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = C.citations(C.token_budget(_hits(spark, sf_dir), 3000))
    return prompts.citation_list(cited).select("query_id", "as_text", F.json_array_length("as_json").alias("n"))


def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut in four parts of sixteen, question against document: the five best of each of all documents."""
    part = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))
    docs = _vectors(spark, sf_dir).select("chunk_id", part(F.col("vector")).alias("d"))
    asked = _asked(spark, sf_dir).select("query_id", part(F.col("vector")).alias("vectors"))
    found = late_interaction_best(docs.withColumnRenamed("d", "vectors"), asked, 5)
    return R.top(found.withColumn("score", F.round("score", 6)), 5).select("query_id", "rank", "chunk_id", "score")


def late_interaction_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty nearest by whole vectors, ordered anew by their parts."""
    part = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))
    vectors, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    first = R.dense(vectors, asked, 50).select("query_id", "chunk_id", F.col("score").alias("first_score"))
    pairs = first.join(asked.select("query_id", part(F.col("vector")).alias("q")), "query_id").join(vectors.select("chunk_id", part(F.col("vector")).alias("d")), "chunk_id")
    scored = pairs.select("query_id", "chunk_id", "first_score", F.round(prompts.max_sim(F.col("q"), F.col("d")), 6).alias("score"))
    return R.top(scored, 5).select("query_id", "rank", "chunk_id", "score", "first_score")


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact hits from an index that is kept; lists that cannot hold one are not read."""
    index = ann.VectorIndex(spark, shared_folder(spark))
    index.build(_vectors(spark, sf_dir))
    return index.search(_asked(spark, sf_dir)).select("query_id", "rank", "chunk_id", "score")


def filtered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a column that the index keeps is applied in its lists."""
    index = ann.VectorIndex(spark, shared_folder(spark))
    index.build(_vectors(spark, sf_dir))
    return index.search(_asked(spark, sf_dir), 5, {"label": {"lt": 5}}).select("query_id", "rank", "chunk_id", "score")


QUERIES = {
    "prompt_messages": messages,
    "key_terms": key_terms,
    "model_limits": model_limits,
    "citation_lists": citation_lists,
    "rerank_late_interaction": late_interaction,
    "rerank_late_interaction_hits": late_interaction_reranked,
    "ann_search": approximate,
    "ann_filtered": filtered_index,
}

_TOK = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
_LIMIT = "CASE " + " ".join(f"WHEN contains(lower(model), '{m}') THEN {n}" for m, n in prompts.MODEL_LIMITS.items()) + f" ELSE {prompts.UNKNOWN_LIMIT} END"
SQL = {
    "prompt_messages": f"""
WITH u AS (SELECT *, row_number() OVER w AS back, sum({_TOK.format("text")} + 4) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
h AS (SELECT conv_id, string_agg(concat(role, ':', text), '|' ORDER BY turn) AS said, count(*) AS n, sum(4 + {_TOK.format("text")}) AS tokens FROM u WHERE back <= 12 AND used <= 400 GROUP BY conv_id),
e AS (SELECT conv_id, min_by(text, turn) AS first, max_by(text, turn) AS question FROM conversations GROUP BY conv_id),
m AS (SELECT e.conv_id, n, tokens, said, CASE WHEN e.conv_id % 3 = 0 OR first = '' THEN concat('## Question', chr(10), chr(10), question, chr(10), chr(10), 'No sources were found for this question; say so.')
  ELSE concat('## Sources', chr(10), chr(10), first, chr(10), chr(10), '---', chr(10), chr(10), '## Question', chr(10), chr(10), question) END AS content FROM e LEFT JOIN h ON e.conv_id = h.conv_id)
SELECT conv_id, (2 + coalesce(n, 0))::INT AS n_messages, (2 + 4 + {len(SYSTEM) // 4} + coalesce(tokens, 0) + 4 + {_TOK.format("content")})::INT AS n_tokens,
  md5(concat_ws('|', 'system:{SYSTEM}', said, concat('user:', content))) AS digest FROM m""",
    "key_terms": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({", ".join(repr(w) for w in prompts.NO_TERMS)})) AS w FROM documents)
SELECT doc_id, array_to_string(list_slice(w, 1, 5), ' ') AS terms FROM w""",
    "model_limits": f"""
WITH m AS (SELECT [{", ".join(repr(m) for m in MODELS)}][event_id % {len(MODELS)} + 1] AS model FROM events) SELECT model, {_LIMIT} AS window, count(*) AS n FROM m GROUP BY 1, 2""",
    "citation_lists": f"""
WITH {_HITS}, u AS (SELECT *, row_number() OVER w AS source_no, sum({_TOK.format("text")}) OVER w AS used FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id))
SELECT query_id, string_agg(concat('[', source_no, '] ', document_id, printf(' (%.3f)', score)), chr(10) ORDER BY source_no) AS as_text, count(*)::INT AS n FROM u WHERE used <= 3000 OR source_no = 1 GROUP BY query_id""",
    "rerank_late_interaction": """
WITH p AS (SELECT vec_id, i, list_slice(list_transform(embedding, lambda x: x::DOUBLE), i * 16 + 1, i * 16 + 16) AS v FROM embeddings, (SELECT unnest(range(0, 4)) AS i)),
b AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, q.i, max(list_dot_product(q.v, d.v)) AS best FROM p q JOIN benchmark k ON q.vec_id = k.item_id, p d GROUP BY 1, 2, 3),
s AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM b GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""",
    "rerank_late_interaction_hits": f"""
WITH {UNITS}, h AS (SELECT query_id, chunk_id, score AS first_score FROM {_top("cosines", 50)}),
p AS (SELECT vec_id, i, list_slice(list_transform(embedding, lambda x: x::DOUBLE), i * 16 + 1, i * 16 + 16) AS v FROM embeddings, (SELECT unnest(range(0, 4)) AS i)),
b AS (SELECT query_id, chunk_id, first_score, q.i, max(list_dot_product(q.v, d.v)) AS best FROM h JOIN p q ON q.vec_id = query_id JOIN p d ON d.vec_id = chunk_id GROUP BY ALL),
s AS (SELECT query_id, chunk_id, first_score, round(sum(best), 6) AS score FROM b GROUP BY ALL)
SELECT query_id, rank::INT AS rank, chunk_id, score, first_score FROM {_top("s", 5)}""",
    "ann_filtered": f"WITH {UNITS}, k AS (SELECT * FROM cosines WHERE label < 5) SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('k', 5)}",
    "ann_search": f"WITH {UNITS} SELECT query_id, rank::INT AS rank, chunk_id, score FROM {_top('cosines', 10)}",
}
