"""Question understanding over the benchmark's items and the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.plans.common import table
from tessera.plans.texts import BEST_LANGUAGE, language_counts_sql

#: Questions are made of the texts by one of these beginnings and an end, by turns.
FORMS = (
    ("What is the ", "?"), ("what are ", ""), ("How to compare it's ", " better"), ("Why don't ", "?"), ("when ", ""), ("Tell me about  ", ""), ("I can't see year:2024 tag:x, ", " year:2025."),
    ("can you show me the  ", ""), ("explain machine learning training data ", ""), ("(", ")!"), ("What does  ", "?"), ("steps for revenue growth ", ""),
)


def _formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    form = F.lit(None).cast("string")
    for i, (before, after) in enumerate(FORMS):
        form = F.when((F.col("conv_id") + F.col("turn")) % len(FORMS) == i, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(form)
    return turns.select("conv_id", "turn", form.alias("query"))


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _formed(spark, sf_dir).select("conv_id", "turn", Q.analyze(F.col("query")).alias("a")).select("conv_id", "turn", "a.*")
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("filters")), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return got.withColumn("stopwords", F.array_join("stopwords", " ")).withColumn("filters", entries)


def rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir).select("conv_id", "turn", Q.rewrite(F.col("query")).alias("rewritten"))


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir).select("conv_id", "turn", Q.expand(F.col("query")).alias("expanded"))


QUERIES = {"query_analyze": analyze, "query_rewrite": rewrite, "query_expand": expand}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FORMED = (
    "WITH f AS (SELECT conv_id, turn, CASE (conv_id + turn) % "
    + str(len(FORMS))
    + " ".join(f" WHEN {i} THEN concat({_quoted(a)}, text, {_quoted(b)})" for i, (a, b) in enumerate(FORMS))
    + " END AS query FROM conversations WHERE role = 'user')"
)
_LISTED = lambda ws: ", ".join(_quoted(w) for w in ws)
_BEGINS = lambda ws: f"regexp_matches(lower(n), '^({'|'.join(ws)})')"
_contracted = "trim(query)"
for _short, _long in Q.CONTRACTIONS.items():
    # RE2's \b knows ASCII letters only; a letter of another kind is no word's end
    _contracted = f"regexp_replace({_contracted}, {_quoted('(?i)' + chr(92) + 'b' + _short + chr(92) + 'b')}, {_quoted(_long)}, 'g')"
_PREFIXED = "CASE " + " ".join(f"WHEN regexp_matches(q, {_quoted(p)}) THEN trim(regexp_replace(q, {_quoted(p)}, ''))" for p in Q.PREFIXES) + " ELSE q END"

_MEANINGS = "MAP {" + ", ".join(f"{_quoted(k)}: [{_LISTED(v)}]" for k, v in Q.SYNONYMS.items()) + "}"

SQL = {
    "query_analyze": _FORMED
    + rf""", g AS (SELECT *, trim(regexp_replace(trim(query), '\s+', ' ', 'g'), {_quoted(Q.EDGES)}) AS n,
  list_transform(regexp_extract_all(query, {_quoted(Q.FILTER)}, 1), lambda x: lower(x)) AS ks, list_transform(regexp_extract_all(query, {_quoted(Q.FILTER)}, 2), lambda x: trim(x, {_quoted(".,!?;:'" + chr(34))})) AS vs FROM f),
e AS (SELECT conv_id, turn, unnest(ks) AS k, unnest(vs) AS v, generate_subscripts(ks, 1) AS i FROM g),
m AS (SELECT conv_id, turn, k, max_by(v, i) AS v FROM e GROUP BY ALL), j AS (SELECT conv_id, turn, string_agg(concat(k, '=', v), '&' ORDER BY k) AS filters FROM m GROUP BY ALL)
SELECT g.conv_id, g.turn, n AS normalized, CASE WHEN length(n) < 10 OR length(n) < 20 OR n_en + n_fr + n_de + n_es = 0 THEN 'en' ELSE {BEST_LANGUAGE.replace("body", "n")} END AS language, len(list_filter(regexp_split_to_array(n, '\s+'), lambda x: x <> ''))::INT AS n_tokens,
  array_to_string(list_filter(regexp_split_to_array(lower(n), '\s+'), lambda x: x IN ({_LISTED(Q.STOPWORDS)})), ' ') AS stopwords, coalesce(filters, '') AS filters,
  regexp_matches(lower(trim(query)), '^({"|".join(Q.STARTERS)})') OR ends_with(trim(query), '?') AS is_question,
  CASE WHEN len(list_filter(regexp_split_to_array(lower(n), '\s+'), lambda x: x IN ({_LISTED(Q.COMPARATIVE)}))) > 0 THEN 'comparative' WHEN {_BEGINS(Q.PROCEDURAL)} THEN 'procedural'
    WHEN {_BEGINS(Q.EXPLANATORY)} THEN 'explanatory' WHEN {_BEGINS(Q.EXPLORATORY)} THEN 'exploratory' ELSE 'factual' END AS query_type
FROM (SELECT *, {language_counts_sql("n")} FROM g) g LEFT JOIN j ON g.conv_id = j.conv_id AND g.turn = j.turn""",
    "query_rewrite": _FORMED
    + rf""", c AS (SELECT conv_id, turn, {_contracted} AS q FROM f), p AS (SELECT conv_id, turn, {_PREFIXED} AS q FROM c), l AS (SELECT *, trim(lower(q), '?.') AS l FROM p)
SELECT conv_id, turn, CASE WHEN regexp_matches(l, '^(what is |what are )') THEN concat(regexp_replace(l, '^(what is |what are )(a |an |the |)', ''), ' what is definition')
  WHEN regexp_matches(l, '^(what does |what do )') THEN concat(regexp_replace(l, '^(what does |what do )(a |an |the |)', ''), ' what does') WHEN starts_with(l, 'how to ') THEN l
  WHEN starts_with(l, 'why ') THEN concat(substr(l, 5), ' reasons why') WHEN starts_with(l, 'when ') THEN concat(substr(l, 6), ' date timeline') ELSE q END AS rewritten FROM l""",
    "query_expand": _FORMED
    + f""", w AS (SELECT *, lower(query) AS l, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '') AS ws FROM f),
p AS (SELECT *, list_filter([{_LISTED(Q.SYNONYMS)}], lambda k: contains(l, k)) AS ps FROM w),
m AS (SELECT *, flatten(list_transform(ws[1:5], lambda x: list_concat(list_transform(ps, lambda k: {{'phrase': k, 'itself': false}}), CASE WHEN x IN ({_LISTED(Q.SYNONYMS)}) THEN [{{'phrase': x, 'itself': true}}] ELSE [] END)))[1:5] AS ms, []::VARCHAR[] AS o0 FROM p), """
    + ", ".join(
        f"o{i} AS (SELECT *, CASE WHEN len(ms) < {i} THEN o{i - 1} ELSE list_concat(o{i - 1}, list_filter(({_MEANINGS})[ms[{i}].phrase], lambda s: NOT (CASE WHEN ms[{i}].itself THEN list_contains(ws, s) ELSE contains(l, s) END) AND NOT list_contains(o{i - 1}, s))[1:3]) END AS o{i} FROM {'m' if i == 1 else f'o{i - 1}'})"
        for i in range(1, 6)
    )
    + " SELECT conv_id, turn, CASE WHEN len(o5) > 0 THEN concat(query, ' (', array_to_string(o5, ' '), ')') ELSE query END AS expanded FROM o5",
}
