"""Messages for a model, token counts, windows of models, key terms, citations as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.let import once
from tessera.functions.tokens import model_tokens

# Tokens that models take, by parts of their names; the first that fits counts (fixed values)
MODEL_LIMITS = {
    "nvidia/llama-3.1-nemotron-70b-instruct": 131072,
    "nvidia/llama-3.1-nemotron-8b-instruct": 131072,
    "meta/llama-3.1-70b-instruct": 131072,
    "meta/llama-3.1-8b-instruct": 131072,
    "meta/llama-3.3-70b-instruct": 131072,
    "meta/llama-3.2-3b-instruct": 131072,
    "mistralai/mixtral-8x22b-instruct-v0.1": 65536,
    "mistralai/mixtral-8x7b-instruct-v0.1": 32768,
    "mistralai/mistral-large": 131072,
    "gpt-4o": 128000,
    "gpt-4o-mini": 128000,
    "gpt-4-turbo": 128000,
    "gpt-3.5-turbo": 16385,
    "claude-3-5-sonnet": 200000,
    "claude-3-opus": 200000,
    "claude-3-sonnet": 200000,
    "claude-3-haiku": 200000,
}
UNKNOWN_LIMIT = 8192
# Words that are no key terms (fixed values)
NO_TERMS = "what when where why how which that this with from they have been were will would could should does about there their your".split()


def context_limit(model: Column) -> Column:
    lower = F.lower(model)
    return F.coalesce(*(F.when(lower.contains(name), limit) for name, limit in MODEL_LIMITS.items()), F.lit(UNKNOWN_LIMIT))


def messages(system: str, history: Column, context: Column, question: Column, note: str = "No sources were found for this question; say so.") -> Column:
    """The system's message, the history's, and the question with its sources, or with a note that there are none."""
    asked = F.concat(F.lit("## Question\n\n"), question)
    user = F.when(F.coalesce(context, F.lit("")) == "", F.concat(asked, F.lit(f"\n\n{note}"))).otherwise(F.concat(F.lit("## Sources\n\n"), context, F.lit("\n\n---\n\n"), asked))
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    return F.concat(one("system", F.lit(system)), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), one("user", user))


def message_tokens(said: Column) -> Column:
    """2, and 4 and its tokens for each message."""
    return F.aggregate(said, F.lit(2), lambda n, m: n + 4 + model_tokens(m["content"]))


def key_terms(text: Column, most: int = 5) -> Column:
    """The first words of four ASCII letters or more that say something."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}+(?![\p{L}\p{N}_])"), 0)
    return F.slice(F.filter(words, lambda w: ~w.isin(*NO_TERMS)), 1, most)


def three_places(value: Column) -> Column:
    """A number as text with three places, rounded by its exact binary value, halves to the even digit, as printf does.

    format_string rounds the shortest decimal: 234.1925, which lies below its decimal, becomes 234.193 there. From 2**63 on, and
    for what is not finite, the text is still that of format_string.
    """

    def of(x: Column) -> Column:
        whole = F.floor(F.abs(x))
        # the rest in two parts, so that both products are exact
        rest = once(F.abs(x) - whole, lambda r: once(r.cast("float").cast("double"), lambda high: F.struct((high * 1000).alias("high"), ((r - high) * 1000).alias("low"))))
        text = once(once(rest, rounded), lambda n: F.concat((whole + F.when(n == 1000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0")))
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        return F.when(F.abs(x) < 2.0**63, F.concat(sign, text)).when(x.isNotNull(), F.format_string("%.3f", x))

    def rounded(p: Column) -> Column:
        n = F.floor(p["high"])
        beyond = (p["high"] - n - 0.5) + p["low"]
        return n + F.when((beyond > 0) | ((beyond == 0) & (n % 2 == 1)), 1).otherwise(0)

    return once(value.cast("double"), of)


def citation_list(rows: DataFrame) -> DataFrame:
    """(query_id, as_text, as_json) of numbered citations (query_id, index, document_id, score); what is null is left out of its line."""
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "document_id", "score"))).alias("cited"))
    shown = lambda c: F.concat(F.lit(" ("), three_places(c["score"]), F.lit(")"))
    line = lambda c: F.concat_ws("", F.lit("["), c["index"].cast("string"), F.lit("] "), c["document_id"].cast("string"), shown(c))
    return held.select("query_id", F.array_join(F.transform("cited", line), "\n").alias("as_text"), F.to_json("cited").alias("as_json"))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each of the query's vectors the largest product with one of the document's, added up."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
