"""Secrets: rules, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import planted
from tessera.llm.common import slices, strings, table
from tessera.llm.crf import Model, Words, fit, spans_of, tokens_of
from tessera.llm.pii import joined, number

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")


def rules(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; leftmost and non-overlapping for each kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: About so many documents are read for passages to plant secrets in; of passages so many are used at most, those of the least hash.
TRAINING_DOCS, PASSAGES = 20_000, 4_000
#: A passage has about so many words.
PASSAGE_WORDS = 40


def passages(docs: DataFrame, most: int = PASSAGES, documents: int = TRAINING_DOCS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Passages of a bounded sample of documents with the spans that the rules find in them: the same on each run.

    Of each document that a hash of doc_id and text picks one passage is taken,
    and one around a word that is not of letters only, if there is one.
    """
    n = docs.count()
    every = max(1, n // documents)
    # the hash takes doc_id too, so that a text of very many copies is not in the sample as a whole
    order = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = docs.select(F.col("text").cast("string"), order.alias("h")).filter(F.pmod(F.col("h"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, h in zip(strings(batch.column("text")), batch.column("h").to_pylist(), strict=True):
                words = text.split(" ")
                odd = [i for i, w in enumerate(words) if not w.rstrip(".,;:!?").isalpha()]
                for place in [h % len(words), *([odd[h % len(odd)]] if odd else [])]:
                    start = max(0, place - PASSAGE_WORDS // 2)
                    out.append((" ".join(w[:200] for w in words[start : start + PASSAGE_WORDS]), zlib.crc32(f"{h}/{place}".encode())))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], ["passage", "k"])

    found = sample.mapInArrow(run, "passage string, k long").distinct().orderBy("k", "passage").limit(most)
    return [(r["passage"], _values(r["passage"])) for r in found.collect()]


def _values(text: str) -> list[tuple[int, int]]:
    """Where the rules' secrets are, without the names that they are assigned to; none overlapping another."""
    spans = []
    for start, end, kind in rules(text):
        at = ASSIGN.match(text, start).start(2) if kind == "assign" else start
        if not spans or at >= spans[-1][1]:
            spans.append((at, end))
    return spans


def labelled(given: list[tuple[str, list[tuple[int, int]]]], kinds: tuple[str, ...] = tuple(planted.SECRETS), seed: int = 7) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts and their secrets' spans: half of the passages as they are, the others with planted secrets and decoys."""
    dice = random.Random(seed)
    texts, spans = [], []
    for i, (passage, own) in enumerate(given):
        if i % 2 == 0:
            texts.append(passage)
            spans.append(own)
        if i % 2 or own:
            shown, added, _ = planted.example(passage, dice, kinds, secrets=dice.choice([0, 1, 1, 2]))
            texts.append(shown)
            spans.append(_joined(added, _values(shown)))
    return texts, spans


def _joined(first: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted(first + [m for m in more if all(m[1] <= a or b <= m[0] for a, b in first)])


def train(docs: DataFrame, most: int = PASSAGES) -> Model:
    """A tagger fitted on passages of the documents with planted secrets of many kinds, with decoys, and with what the rules find.

    The sample is bounded by PASSAGES and the same on each run. Null texts count
    as empty; repeated rows and repeated passages count once; ties of the
    sample's hash go by the passage. Of an empty table nothing is learned: the
    model tags nothing.
    """
    return fit(*labelled(passages(docs, most)))


def predict(model: Model, texts: list[str], words: Words | None = None) -> list[list[tuple[int, int]]]:
    """The spans that the tagger finds in each text."""
    tokens = tokens_of(texts, words or Words(model.lexicon))
    return spans_of(model.tags(tokens), tokens, texts)


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, start, end) in code points of the whole text, end exclusive.

    `base` holds what the rules find, by start and kind; `more` (kind "crf") the
    secrets that the tagger finds apart from these, all tokens of the whole text
    being decoded by Viterbi. Without a model one is fitted on the documents.
    Null text counts as empty; doc_id may be null or repeated; one row a
    document; an empty table gives no rows; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    spans = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.value.lexicon)
        for batch in slices(batches, "text", 2_000_000):
            texts = strings(batch.column("text"))
            base, more = [], []
            for text, tagged in zip(texts, predict(model.value, texts, words), strict=True):
                found = rules(text)
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                more.append([{"kind": "crf", "start": s, "end": e} for s, e in tagged if all(e <= a or b <= s for a, b, _ in found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {spans}, more {spans}")


def mask_secrets(docs: DataFrame, model: Model | None = None, mask: str = "[secret]") -> DataFrame:
    """The documents with each secret's span replaced by the mask, and n_chars, if there, the new length.

    Null text stays null; repeated rows stay; an empty table stays empty; all
    other columns stay as they are, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)

    def masked(text: str, tagged: list[tuple[int, int]]) -> str:
        out, last = [], 0
        spans = sorted([(s, e) for s, e, _ in rules(text)] + tagged)
        for start, end in spans:
            if start >= last:
                out += [text[last:start], mask]
            last = max(last, end)
        return "".join(out) + text[last:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.value.lexicon)
        for batch in slices(batches, "text", 2_000_000):
            given = batch.column("text").to_pylist()
            tagged = predict(model.value, [t or "" for t in given], words)
            texts = [None if t is None else masked(t, spans) for t, spans in zip(given, tagged, strict=True)]
            names = batch.schema.names
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    place = F.array(*map(F.lit, (*KINDS, "crf")))
    every = F.array_sort(
        F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return found.select(
        "doc_id",
        *(number("base", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
SQL: dict[str, str] = {}
