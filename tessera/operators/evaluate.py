"""Retrieval metrics, answer metrics and grounding for whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import answer_sentences, grounding_tokens, metric_tokens
from tessera.operators.context import citation_numbers


def metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of qrels (query_id, chunk_id, grade): recall, precision and nDCG at each k, average precision, reciprocal rank.

    `run` has query_id, chunk_id and rank (from 1). The ideal list is that of
    the relevant chunks; precision divides by k. Queries without hits get 0.
    """
    hits = run.join(qrels.select("query_id", "chunk_id", "grade"), ["query_id", "chunk_id"], "inner")
    hits = hits.withColumn("_seen", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gain = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)
    parts = [F.sum(F.col("_seen") / F.col("rank")).alias("_ap"), F.min("rank").alias("_first")]
    for k in ks:
        within = F.col("rank") <= k
        parts += [F.count_if(within).alias(f"_hits_{k}"), F.sum(F.when(within, gain)).alias(f"_dcg_{k}")]
    got = hits.groupBy("query_id").agg(*parts)
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id"))
    ideal = qrels.withColumn("rank", ideal_rank)
    wanted = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"_ideal_{k}") for k in ks))
    both = wanted.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = ["query_id", "n_relevant"]
    for k in ks:
        out += [
            zero(F.col(f"_hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            zero(F.col(f"_hits_{k}") / k).alias(f"precision_{k}"),
            zero(F.col(f"_dcg_{k}") / F.nullif(F.col(f"_ideal_{k}"), F.lit(0.0))).alias(f"ndcg_{k}"),
        ]
    return both.select(*out, zero(F.col("_ap") / F.col("n_relevant")).alias("ap"), zero(1 / F.col("_first")).alias("rr"))


def macro(per_query: DataFrame) -> DataFrame:
    """One row: the means over queries, rounded to four places."""
    names = [c for c in per_query.columns if c not in ("query_id", "n_relevant")]
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in names))


def covered(of: Column, by: Column) -> Column:
    """The share of one token set that is in another; 0 for an empty one."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, by)) / F.size(of)).otherwise(0.0)


def answer_metrics(cases: DataFrame) -> DataFrame:
    """Faithfulness, answer relevancy, context precision and recall of (query_id, question, answer, reference, sources array)."""
    t = cases.select(
        "query_id", metric_tokens(F.col("question")).alias("q"), metric_tokens(F.col("answer")).alias("a"), metric_tokens(F.col("reference")).alias("r"), F.transform("sources", metric_tokens).alias("s")
    )
    t = t.withColumn("all", F.array_distinct(F.flatten("s")))
    useful = F.size(F.filter("s", lambda x: F.size(F.array_intersect(x, F.col("a"))) / F.greatest(F.size(x), F.lit(1)) >= 0.05))
    return t.select(
        "query_id",
        covered(F.col("a"), F.col("all")).alias("faithfulness"),
        covered(F.col("q"), F.col("a")).alias("answer_relevancy"),
        F.when((F.size("s") > 0) & (F.size("a") > 0), useful / F.size("s")).otherwise(0.0).alias("context_precision"),
        covered(F.col("r"), F.col("all")).alias("context_recall"),
    )


SUPPORT, LEAST_SENTENCE = 0.12, 30
# Beginnings of sentences about the answer itself, and words that admit a gap (fixed values)
META = ("based on", "according to", "the sources", "the documents", "the context", "as mentioned", "as stated", "as noted", "in summary", "in conclusion", "overall,", "note that")
NO_INFORMATION = (
    "i don't have enough information", "i cannot answer", "i don't have the specific", "i don't have access to", "not provided in the context",
    "does not contain information", "not mentioned in the sources", "cannot find this information", "the context does not", "based on the provided context, i cannot",
)


def factual(sentence: Column) -> Column:
    """A claim about facts: no talk about the sources, no question, long enough, with a number or a name or over 80 characters."""
    meta = F.lower(F.trim(sentence)).rlike("^(" + "|".join(META) + ")")
    facts = sentence.rlike(r"\b\d+(?:\.\d+)?(?:%|x|k|M|B)?\b") | sentence.rlike(r"\b[A-Z][a-z]{2,}\b") | (F.length(sentence) > 80)
    return ~meta & (F.length(sentence) >= LEAST_SENTENCE) & ~F.trim(sentence).endswith("?") & facts


def admits_gap(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(NO_INFORMATION))


def _weights(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, share): each term's share of the text's tokens."""
    tokens = texts.select(*keys, grounding_tokens(F.col("text")).alias("t")).select(*keys, F.size("t").alias("n"), F.explode("t").alias("term"))
    return tokens.groupBy(*keys, "n", "term").agg(F.count(F.lit(1)).alias("c")).select(*keys, "term", (F.col("c") / F.col("n")).alias("share"))


def grounding(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, sentence, best_chunk, similarity, supported, factual) of each sentence of 30 characters or more.

    `answers` (answer_id, answer), `sources` (answer_id, chunk_id, text).
    Term weights are share * idf with idf = ln((n + 1) / (df + 1)) + 1 over the
    answer's sources and the answer itself; the best source is that of the
    highest cosine, and supports the sentence from 0.12 on.
    """
    parts = answers.select("answer_id", F.posexplode(answer_sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    parts = parts.filter(F.length("sentence") >= LEAST_SENTENCE)
    whole = answers.select("answer_id", F.lit(None).cast("long").alias("chunk_id"), F.col("answer").alias("text"))
    texts = sources.select("answer_id", F.col("chunk_id").cast("long"), "text").unionByName(whole)
    n = texts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    weights = _weights(texts, ["answer_id", "chunk_id"])
    df = weights.groupBy("answer_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(n, "answer_id").select("answer_id", "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    of_chunks = weights.filter("chunk_id IS NOT NULL").join(idf, ["answer_id", "term"]).select("answer_id", "chunk_id", "term", (F.col("share") * F.col("idf")).alias("w"))
    of_parts = _weights(parts.select("answer_id", "sentence_no", F.col("sentence").alias("text")), ["answer_id", "sentence_no"])
    of_parts = of_parts.join(idf, ["answer_id", "term"], "left").select("answer_id", "sentence_no", "term", (F.col("share") * F.coalesce("idf", F.lit(1.0))).alias("v"))
    long_c = of_chunks.groupBy("answer_id", "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("lc"))
    long_p = of_parts.groupBy("answer_id", "sentence_no").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("lp"))
    dots = of_parts.join(of_chunks, ["answer_id", "term"]).groupBy("answer_id", "sentence_no", "chunk_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("lc") * F.col("lp")), 6)
    scored = dots.join(long_c, ["answer_id", "chunk_id"]).join(long_p, ["answer_id", "sentence_no"]).withColumn("similarity", cosine)
    best = scored.groupBy("answer_id", "sentence_no").agg(F.max_by("chunk_id", F.struct("similarity", -F.col("chunk_id"))).alias("best_chunk"), F.max("similarity").alias("similarity"))
    similarity = F.coalesce("similarity", F.lit(0.0))
    return parts.join(best, ["answer_id", "sentence_no"], "left").select(
        "answer_id", "sentence_no", "sentence", "best_chunk", similarity.alias("similarity"), (similarity >= SUPPORT).alias("supported"), factual(F.col("sentence")).alias("factual")
    )


def citation_coverage(answer: Column) -> Column:
    """The share of an answer's sentences, of ten characters or more with their citations, that cite a source by [n]; 0 if there are none."""
    split = F.split(F.regexp_replace(answer, r"([.!?])\s+", "$1\x01"), "\x01")
    parts = F.filter(F.transform(split, lambda x: F.trim(x)), lambda s: F.length(s) >= 10)
    return F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda s: s.rlike(r"\[\d+\]"))) / F.size(parts)).otherwise(0.0)


#: An answer that is longer must cite something if it has sources.
LEAST_CITED = 80


def grounding_report(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each of `answers` (answer_id, answer): what is wrong with it, judged by its `sources` (answer_id, chunk_id, text).

    citation_count and invalid_citations (numbers beyond the sources),
    admits_gap, confidence (the mean similarity of the sentences that have
    terms, to three places; 1 if there are none or no sources), n_sentences,
    n_unsupported (claims that no source supports, unless the answer admits a
    gap), citation_coverage, issues and valid. Issues are those of the
    citations, of the sentences and of the response as such.
    """
    judged = grounding(answers, sources).filter(F.size(grounding_tokens(F.col("sentence"))) > 0)
    number = sources.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_sources"))
    loose = ~F.col("supported") & F.col("factual")
    line = F.struct("sentence_no", F.format_string("low grounding (%.2f): %s", F.col("similarity"), F.substring("sentence", 1, 80)).alias("said"))
    of = judged.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg("similarity").alias("mean"), F.array_sort(F.collect_list(F.when(loose, line))).alias("loose")
    )
    cited = citation_numbers(F.col("answer"))
    rows = answers.select("answer_id", "answer", cited.alias("cited"), admits_gap(F.col("answer")).alias("admits_gap")).join(number, "answer_id", "left").join(of, "answer_id", "left")
    n = F.coalesce("n_sources", F.lit(0))
    invalid = F.filter("cited", lambda c: (c < 1) | (c > n))
    loose = F.when(F.col("admits_gap") | (n == 0), F.array()).otherwise(F.coalesce(F.transform("loose", lambda s: s["said"]), F.array()))
    missing = F.when((F.size("cited") == 0) & (F.length(F.trim("answer")) > LEAST_CITED) & (n > 0), F.array(F.lit("no citations"))).otherwise(F.array())
    issues = F.concat(F.transform(invalid, lambda c: F.concat(F.lit("no source ["), c.cast("string"), F.lit("]"))), missing, loose.cast("array<string>"), response_issues(F.col("answer")))
    return rows.select(
        "answer_id",
        (F.size("cited") - F.size(invalid)).alias("citation_count"),
        invalid.alias("invalid_citations"),
        "admits_gap",
        F.when(n > 0, F.coalesce(F.round("mean", 3), F.lit(1.0))).otherwise(1.0).alias("confidence"),
        F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"),
        F.size(loose).alias("n_unsupported"),
        F.round(citation_coverage(F.col("answer")), 4).alias("citation_coverage"),
        issues.alias("issues"),
        (F.size(issues) == 0).alias("valid"),
    )


def evaluation_report(per_query: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the means of all metrics (four places), of latency (two), tokens (one) and citation coverage (four).

    `per_query` is what metrics or answer_metrics give; `answers` has query_id,
    answer, latency_ms and tokens.
    """
    said = answers.agg(
        F.count(F.lit(1)).alias("n_answers"), F.round(F.avg("latency_ms"), 2).alias("latency_ms"), F.round(F.avg("tokens"), 1).alias("tokens"), F.round(F.avg(citation_coverage(F.col("answer"))), 4).alias("citation_coverage")
    )
    return macro(per_query).crossJoin(said)


# Patterns of answers that are no answers (fixed values)
REFUSALS = (r"(?i)^I'm (sorry|unable|not able)", r"(?i)^As an AI", r"(?i)^I cannot (answer|complete|provide|fulfill)", r"^\s*```", r"^\s*\{.*\}\s*$")


def response_issues(answer: Column) -> Column:
    """What is wrong with an answer: too short, too long, a refusal, fewer than three words."""
    bare = F.trim(answer)
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda x: x != ""))
    refused = F.lit(False)
    for pattern in REFUSALS:
        refused |= bare.rlike(pattern)
    return F.array_compact(
        F.array(
            F.when(F.length(bare) < 10, F.lit("too short")),
            F.when(F.length(answer) > 50_000, F.lit("too long")),
            F.when(refused, F.lit("refusal")),
            F.when((words > 0) & (words < 3), F.lit("fewer than 3 words")),
        )
    )
