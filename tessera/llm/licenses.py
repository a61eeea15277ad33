"""License scans: an exact join of text blocks and license templates by containment of their word sets, in expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

# Phrases and their labels (fixed values)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of licenses as their publishers word them, with labels (fixed values)
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("gpl", "licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
]

#: A block holds a template if so large a part of the template's words is in it.
THRESHOLD = 0.9
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one other character whose lower case is an ASCII letter, and a letter to stand for it.
KELVIN, OTHER = "\u212a", "\u00e5"
#: Up to so many bytes of templates go to every task.
MOST_BYTES = 64_000_000


def words_of(text: Column) -> Column:
    """The words of a text in lower case; those of ASCII characters are what lower-casing A-Z alone gives. Null has none."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit(OTHER))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), 0)


def plain_words(text: str) -> list[str]:
    """The same words of an ASCII text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


@dataclass
class Template:
    """A template: its words, how many a block must hold, and half the words of a block."""

    label: str
    words: list[str]
    need: int
    half: int
    #: Places of its words in the global order, least first.
    ranks: list[int] = field(default_factory=list)


def templates_of(listed: list[tuple[str, str]], threshold: float) -> list[Template]:
    """A passage of a quarter more words than the template's lies whole in one of the blocks [k * half, k * half + 2 * half)."""
    out = []
    for label, text in listed:
        long = plain_words(text)
        if words := sorted(set(long)):
            # in thousandths, so that no rounding lifts a whole number
            need = -(-len(words) * round(1000 * threshold) // 1000)
            out.append(Template(label, words, max(1, need), 1 << max(2, (len(long) * 5 // 4 - 1).bit_length())))
    return out


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of some words is; counts are added up before they are sent."""
    held = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(*words)))
    return dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()) if words else {}


def ordered(templates: list[Template], counts: dict[str, int]) -> list[str]:
    """All words of the templates, the rarest of the corpus first; each template learns the places of its own, counted from 1."""
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order, 1)}
    for t in templates:
        t.ranks = sorted(place[w] for w in t.words)
    return order


def prefix(t: Template) -> list[int]:
    """Its rarest words: a block that holds enough of a template holds one of them."""
    return t.ranks[: len(t.ranks) - t.need + 1]


def _blocks(words: Column, spots: Column, templates: list[Template], order: list[str]) -> Column:
    """Blocks (half, start, ranks) around prefix words that pass the length filter, for templates of one size of block.

    Only blocks that hold a prefix word are cut out of the text, each once.
    """
    half = templates[0].half
    first = sorted({order[r - 1] for t in templates for r in prefix(t)})
    known = sorted({w for t in templates for w in t.words})
    at = F.filter(spots, lambda i: F.get(words, i).isin(*first))
    both = F.flatten(F.transform(at, lambda i: F.array(F.floor(i / half).cast("int"), F.floor(i / half).cast("int") - 1)))
    numbers = F.array_distinct(F.filter(both, lambda k: k >= 0))

    def block(k: Column) -> Column:
        own = F.array_distinct(F.filter(F.slice(words, k * half + 1, 2 * half), lambda w: w.isin(*known)))
        ranks = F.array_sort(F.transform(own, lambda w: F.array_position(F.lit(order), w).cast("int")))
        return F.struct(F.lit(half).alias("half"), (k * half).alias("start"), ranks.alias("ranks"))

    least = min(t.need for t in templates)
    return F.filter(F.transform(numbers, block), lambda b: F.size(b["ranks"]) >= least)


def _scanned(docs: DataFrame, phrases: dict[str, str], templates: list[Template], order: list[str]) -> DataFrame:
    """A row for each row of docs: row, doc_id, n_words, places (at, label) of the phrases, and blocks that may hold a template."""
    spelled = [(plain_words(p), label) for p, label in phrases.items()]
    wanted = {ws[0] for ws, _ in spelled} | {order[r - 1] for t in templates for r in prefix(t)}
    words, spots = F.col("words"), F.col("spots")
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    every = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*sorted(wanted)))
    read = read.withColumn("spots", F.when((F.size(words) > 0) & F.lit(bool(wanted)), every).otherwise(F.array().cast("array<int>")))

    def stands(ws: list[str], label: str) -> Column:
        def ok(i: Column) -> Column:
            out = F.lit(True)
            for j, w in enumerate(ws):
                out &= F.coalesce(F.get(words, i + j) == w, F.lit(False))
            return out

        return F.transform(F.filter(spots, ok), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<at:int,label:string>>")
    sizes = sorted({t.half for t in templates})
    blocks = [_blocks(words, spots, [t for t in templates if t.half == h], order) for h in sizes]
    no_block = F.array().cast("array<struct<half:int,start:int,ranks:array<int>>>")
    return read.select(
        "row", "doc_id", F.size(words).alias("n_words"), F.concat(none, *(stands(*x) for x in spelled)).alias("places"), F.concat(no_block, *blocks).alias("blocks")
    )


def _joined(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """Each row with every block and every template that it holds: label, start, half, containment; null where there is none.

    The prefix words of blocks and of templates meet by a hash join. What their
    places leave for the overlap, and the length of the block, must reach what
    the template needs; then the overlap itself is counted.
    """
    table_rows = [(t.half, r, j, len(t.ranks), t.need, t.label, t.ranks) for t in templates for j, r in enumerate(prefix(t))]
    schema = "of int, token int, j int, size int, need int, label string, held array<int>"
    prefixes = rows.sparkSession.createDataFrame(table_rows, schema)
    if sum(40 + len(x[5]) + 4 * len(x[6]) for x in table_rows) <= MOST_BYTES:
        prefixes = F.broadcast(prefixes)
    tokens = sorted({x[1] for x in table_rows})
    ranks = F.col("block.ranks")
    some = F.filter(F.transform(ranks, lambda t, i: F.struct(i.alias("i"), t.alias("token"))), lambda e: e["token"].isin(*tokens))
    spread = rows.withColumn("block", F.explode_outer("blocks")).drop("blocks").withColumn("e", F.explode_outer(some))
    n = F.size(ranks)
    may = (
        (F.col("block.half") == F.col("of")) & (F.col("e.token") == F.col("token"))
        & (n >= F.col("need")) & (F.least(n - F.col("e.i"), F.col("size") - F.col("j")) >= F.col("need"))
    )
    met = spread.join(prefixes, may, "left")
    overlap = F.size(F.array_intersect(ranks, F.col("held")))
    met = met.withColumn("overlap", overlap)
    ok = F.col("overlap") >= F.col("need")
    kept = [c for c in rows.columns if c != "blocks"]
    return met.select(
        *kept, F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("block.start")).alias("start"), F.when(ok, F.col("of")).alias("half"),
        F.when(ok, F.col("overlap") / F.col("size")).alias("containment"),
    )


def _prepared(docs: DataFrame, listed: list[tuple[str, str]], threshold: float) -> tuple[list[Template], list[str]]:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    templates = templates_of(listed, threshold)
    order = ordered(templates, frequencies(docs, sorted({w for t in templates for w in t.words})))
    return templates, order


def license_blocks(docs: DataFrame, listed: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, label, start, n_words, containment): every block of a text and template, of whose different words it holds a share of `threshold` or more.

    A block is n_words words from word `start` on (from 0, fewer at the end of
    the text); blocks overlap by half, and are so long for each template that a
    passage of a quarter more words than the template has lies in one whole.
    Words are ordered by the number of documents that hold them, the rarest
    first; only words of templates matter, as others are in no overlap.
    Templates are ASCII texts.

    Null texts are empty, rows of one doc_id and null ones are read each for
    itself, empty tables give no rows, further columns are ignored. A text is
    one array of words in a task, about ten times its bytes.
    """
    templates, order = _prepared(docs, listed, threshold)
    met = _joined(_scanned(docs, {}, templates, order), templates).filter("label IS NOT NULL")
    return met.select("row", "doc_id", "label", "start", (2 * F.col("half")).alias("n_words"), "containment").distinct().drop("row")


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, listed: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """What each text says of its license, one row for each row of docs.

    doc_id, n_words, n_base (places where a phrase stands), first_word and
    last_word (its least and greatest place, null without any), base_labels and
    labels (those of phrases, and of phrases and templates in blocks; arrays in
    order), score (the highest containment of a template that was found, 1 with
    a phrase, 0 without anything). Nulls, copies, long texts and clashing
    columns are as in license_blocks; an empty table gives no rows.
    """
    templates, order = _prepared(docs, listed, threshold)
    rows = _scanned(docs, phrases, templates, order)
    at = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    rows = rows.select(
        "row", "doc_id", "n_words", F.size("places").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), base.alias("base_labels"), "blocks"
    )
    met = _joined(rows, templates)
    kept = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    each = met.groupBy("row").agg(*(F.first(c).alias(c) for c in kept), F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return each.select(*kept, F.array_sort(F.array_union("base_labels", "more")).alias("labels"), score.alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    wide = [F.col(c).cast("long").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")]
    return found.select("doc_id", *wide, *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")


QUERIES = {"op13_licenses": op13_licenses}


def _sql(phrases: dict[str, str], listed: list[tuple[str, str]], threshold: float) -> str:
    """The same from all blocks and all templates."""
    templates = templates_of(listed, threshold)
    values = ", ".join(f"({i}, {t.half}, {t.need}, '{t.label}', {t.words!r})" for i, t in enumerate(templates))
    stands = " UNION ALL ".join(
        f"SELECT doc_id, p, '{label}' AS label FROM spots WHERE " + " AND ".join(f"ws[p + {j + 1}] = '{w}'" for j, w in enumerate(plain_words(phrase))) for phrase, label in phrases.items()
    )
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM w),
base AS ({stands}),
bases AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
t(id, half, need, label, held) AS (VALUES {values}),
blocks AS (SELECT doc_id, half, list_distinct(ws[p + 1:p + 2 * half]) AS own FROM (SELECT doc_id, ws, half, unnest(range(0, len(ws), half)) AS p FROM w, (SELECT DISTINCT half FROM t))),
met AS (SELECT doc_id, label, need, len(held) AS size, len(list_intersect(own, held)) AS overlap FROM blocks JOIN t USING (half)),
more AS (SELECT doc_id, label, max(overlap::DOUBLE / size) AS held FROM met WHERE overlap >= need GROUP BY doc_id, label),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM more) GROUP BY doc_id),
best AS (SELECT doc_id, max(held) AS held FROM more GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(held, 0) END::DOUBLE AS score
FROM w LEFT JOIN bases USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = {"op13_licenses": _sql(PHRASES, TEMPLATES, THRESHOLD)}
