"""Benchmark decontamination by windows of templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, table, utf8

#: Up to so many benchmark windows the join gets them as a broadcast table.
MOST_BROADCAST = 500_000
#: Each task gets one table of bits for the hashes of all benchmark windows: 2 ** LEAST_BITS at least, 2 ** MOST_BITS (16 MB) at
#: most. What passes it is joined, so that a full table costs time, never a result.
LEAST_BITS, MOST_BITS = 20, 27
# Units of measurement, currencies and times (fixed values)
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms "
    b"ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"percent pct usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz kb mb gb tb w kw v meter meters metre metres kilometer kilometers degree degrees mph kmh".split()
)
NUMBER, NAME, UNIT = (xxhash.xxh64_intdigest(x) for x in ("<number>", "<name>", "<unit>"))
#: ASCII punctuation: what ends a sentence becomes a token of its own, the rest separates words.
MARKS = bytes(1 if chr(b) in ".!?\n:;" else b if b > 127 or chr(b).isalnum() or b == 2 else 32 for b in range(256))
#: A number with groups of thousands or with a decimal point or comma; '1,2,3' is none, and '1,2' is one.
SEPARATED = re.compile(rb"(?<![0-9])(?<![0-9][.,])(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+|[0-9]+[.,][0-9]+)(?![0-9]|[.,][0-9])")
THOUSANDS = re.compile(rb",(?=[0-9]{3}(?![0-9]))")
#: What a unit or a sign is glued to becomes a word of its own: '5km', '2x', '3rd', '€5'.
GLUED = re.compile("(?<![A-Za-z0-9\x02\x80-\xff])([0-9]+(?:\x02[0-9]+)*)(?=[A-Za-z\x80-\xff]+(?![A-Za-z0-9\x02\x80-\xff]))".encode("latin-1"))
SIGNS = tuple(x.encode() for x in "€£¥₹")
CURRENCY = re.compile(b"((?:" + b"|".join(SIGNS) + b")+)(?=[0-9])")
IS_NUMBER, IS_NAME, IS_UNIT, IS_END = 1, 2, 4, 8


def tokens_of(text: bytes) -> list[bytes]:
    """Words, a number with its separators being one (its decimal sign as \\x02), and \\x01 for each mark that ends a sentence."""
    text = text.replace(b"\x02", b" ")
    # each of these changes nothing where the short pattern before it is not found
    if re.search(rb"[0-9][.,][0-9]", text):
        text = SEPARATED.sub(lambda m: re.sub(rb"[.,]", b"\x02", THOUSANDS.sub(b"", m[0])), text)
    if any(sign in text for sign in SIGNS):
        text = CURRENCY.sub(rb"\1 ", text)
    if re.search(b"[0-9][A-Za-z\x80-\xff]", text):
        text = GLUED.sub(rb"\1 ", text)
    return text.translate(MARKS).replace(b"\x01", b" \x01 ").split()


class Codes(dict):
    """Of each word: a hash of its lower-case form above four bits that say what it can stand for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        if word == b"\x01":
            code = IS_END
        else:
            plain = word.decode("utf-8", "replace")
            low = plain.lower()
            if low == plain:
                flags = IS_UNIT if word in UNITS else IS_NUMBER * plain.replace("\x02", "").isdigit()
            else:
                flags = IS_NAME * (len(plain) > 1 and plain[0].isupper() and plain[1:].islower()) + IS_UNIT * (low.encode() in UNITS)
            code = (xxhash.xxh64_intdigest(low) & ~15) | flags
        self[word] = code
        return code


class Windows:
    """Hashes of all windows of `size` words of texts: of the words as they are, of the template, and of the template
    in which a capitalised word that begins a sentence is a name too."""

    def __init__(self, texts: list[bytes], size: int, codes: Codes):
        tokens = [tokens_of(t) for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        code = np.array([codes[w] for t in tokens for w in t], np.uint64)
        of = np.repeat(np.arange(len(texts)), counts)
        flags = (code & np.uint64(15)).astype(np.uint8)
        end = flags == IS_END
        first = np.ones(len(code), bool)
        first[1:] = end[:-1] | (of[1:] != of[:-1])
        word = ~end
        self.words = [[w for w in t if w != b"\x01"] for t in tokens]
        self.of, first, flags, literal = of[word], first[word], flags[word], code[word] & ~np.uint64(15)
        self.starts = np.searchsorted(self.of, np.arange(len(texts)))
        number = (flags & IS_NUMBER) > 0
        name = ((flags & IS_NAME) > 0) & ~first
        unit = (flags & IS_UNIT) > 0
        unit[1:] &= number[:-1] & (self.of[1:] == self.of[:-1])
        unit[:1] = False
        initial = ((flags & IS_NAME) > 0) & first
        self.number, self.unit = number, unit
        self.slot = number | name | unit
        self.wide_slot = self.slot | initial
        shown = np.where(number, np.uint64(NUMBER), np.where(name, np.uint64(NAME), np.where(unit, np.uint64(UNIT), literal)))
        self.size, n = size, max(0, len(literal) - size + 1)
        self.whole = self.of[:n] == self.of[size - 1 : size - 1 + n]
        self.literal, self.template = _hashes(literal, size, n), _hashes(shown, size, n)
        self.wide = _hashes(np.where(initial & ~self.slot, np.uint64(NAME), shown), size, n)
        self.slots, self.wide_slots = self._within(self.slot, n), self._within(self.wide_slot, n)
        #: Windows of one text that are not slots only.
        self.usable = self.whole & (self.slots < size)

    def _within(self, slot: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(slot)])
        return (total[self.size :] - total[: -self.size])[:n] if n else np.zeros(0, int)

    def fillers(self, at: int, wide: bool = False) -> list[str]:
        """What fills the slots of the window at a place, after a sign for the kind of slot: '#' number, 'u' unit, 'n' name."""
        slot = self.wide_slot if wide else self.slot
        start = at - self.starts[self.of[at]]
        own = self.words[self.of[at]][start : start + self.size]
        kinds = np.where(self.number[at : at + self.size], "#", np.where(self.unit[at : at + self.size], "u", "n"))
        return [k + w.decode("utf-8", "replace").lower() for w, s, k in zip(own, slot[at : at + self.size], kinds, strict=True) if s]


def _hashes(codes: np.ndarray, size: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]) ^ (out >> np.uint64(29))
    return out


#: `wide` marks windows in which a word that begins a sentence is a name.
SCHEMA = "id {}, at int, h long, kind string, wide boolean, fillers array<string>"
ARROW = [("at", pa.int32()), ("h", pa.int64()), ("kind", pa.string()), ("wide", pa.bool_()), ("fillers", pa.list_(pa.string()))]


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(id, at, h, kind, wide, fillers) of all windows of all items; items of fewer words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("id").to_pylist(), utf8(batch.column("text")), strict=True):
                w = Windows([text], size, codes)
                usable = w.usable if w.usable.any() else w.whole
                for at in np.flatnonzero(usable):
                    forms = [("literal", False, w.literal, [])]
                    # a template without slots is the literal window
                    if w.slots[at]:
                        forms.append(("template", False, w.template, w.fillers(at)))
                    # of slots only it would be found anywhere
                    if w.slots[at] < w.wide_slots[at] < w.size:
                        forms.append(("template", True, w.wide, w.fillers(at, True)))
                    rows += [{"id": item, "at": int(at), "h": int(h[at].view(np.int64)), "kind": k, "wide": x, "fillers": f} for k, x, h, f in forms]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), *ARROW]))

    return items.mapInArrow(run, SCHEMA.format("long"))


def bit_table(bench: DataFrame, total: int) -> np.ndarray:
    """A bit for the leading bits of each hash, built on Spark; its size grows with the number of windows up to a bound."""
    bits = min(max(LEAST_BITS, total.bit_length() + 10), MOST_BITS)
    # Spark counts the places of its bitmaps from 1
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    blocks = bench.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.toLocalIterator():
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["bucket"] - 1) * len(own)
        out[start : start + len(own)] |= own[: len(out) - start]
    return out


def document_windows(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(id, at, h, kind, wide, fillers) of those of the documents' windows whose hash has its bit in the table."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)
    shift = np.uint64(64 - (len(wanted) * 8).bit_length() + 1)
    kind_of_id = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in slices(batches, "text", 2_000_000):
            ids, texts = batch.column("id"), utf8(batch.column("text"))
            schema = pa.schema([("id", ids.type), *ARROW])
            rows = []
            w = Windows(texts, size, codes)
            forms = (
                ("literal", False, w.literal, w.whole),
                ("template", False, w.template, w.whole & (w.slots > 0)),
                ("template", True, w.wide, w.whole & (w.wide_slots > w.slots)),
            )
            names = ids.to_pylist()
            for kind, wide, hashes, there in forms:
                at = np.flatnonzero(there)
                place = hashes[at] >> shift
                at = at[(given.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                for i in at:
                    rows.append((names[w.of[i]], int(i - w.starts[w.of[i]]), int(hashes[i].view(np.int64)), kind, wide, w.fillers(i, wide) if kind == "template" else []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, SCHEMA.format(kind_of_id))


def contamination(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, coverage, n_slots, reparameterised) of the items that documents hold.

    Numbers (with their separators and decimals, and apart from what is glued to
    them), names (capitalised words inside a sentence) and units after a number
    become typed placeholders; a second template takes the capitalised words
    that begin a sentence as names too. Windows of `size` words of the items'
    templates, and of their words as they are, are joined by hash with those of
    the whole documents. Matches of one alignment count if their slots are
    consistent: equal fillers of the item have equal fillers in the document,
    and different names or units have different ones (different numbers may
    come to be equal by chance). Those of the second template must be together
    with those of the first. A document holds an item if windows at `least` of
    the item's places are found; `reparameterised` if not that many are found
    word by word. Case and ASCII punctuation do not count.

    Null texts count as empty. Items of fewer than `size` words are in no
    document: that few words are in many texts by chance. Rows with a null id
    are left out on both sides; rows that repeat an id are read as one. Empty
    tables give no rows; further columns are ignored. doc_id may be a number or
    a string.
    """
    items = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")).filter("id IS NOT NULL")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string")).filter("id IS NOT NULL AND text <> ''")
    bench = benchmark_windows(items, size).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "h", F.col("fillers").alias("given"), "kind", F.col("wide").alias("item_wide")).distinct()
    bench = cut(bench)
    windows = bench.count()
    small = windows <= MOST_BROADCAST
    found = document_windows(docs, size, bit_table(bench, windows)).withColumnRenamed("id", "doc_id")
    met = found.join(F.broadcast(bench) if small else bench, ["h", "kind"])
    pairs = F.arrays_zip("given", "fillers")
    wide = F.col("wide") | F.col("item_wide")
    gathered = lambda found: F.array_distinct(F.flatten(F.collect_set(found)))
    lines = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("item_at", "kind", wide.alias("wide"))).alias("places"), gathered(F.when(~wide, pairs)).alias("pairs"), gathered(pairs).alias("wide_pairs")
    )

    def agree(found: str):
        names = F.filter(found, lambda p: ~p["given"].startswith("#"))
        each = lambda rows, side: F.size(rows) == F.size(F.array_distinct(F.transform(rows, lambda p: p[side])))
        return each(F.col(found), "given") & each(names, "fillers")

    consistent, wide_consistent = agree("pairs"), agree("wide_pairs")
    # words as they are need no slots to agree
    counts = lambda p: (p["kind"] == "literal") | F.when(p["wide"], wide_consistent).otherwise(consistent)
    counted = F.transform(F.filter("places", counts), lambda p: p["item_at"])
    exact = F.transform(F.filter("places", lambda p: p["kind"] == "literal"), lambda p: p["item_at"])
    held = (
        lines.select("doc_id", "item_id", counted.alias("counted"), exact.alias("exact"), F.when(wide_consistent, F.size("wide_pairs")).when(consistent, F.size("pairs")).otherwise(0).alias("slots"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("counted")))).alias("n_found"),
            F.size(F.array_distinct(F.flatten(F.collect_list("exact")))).alias("n_exact"),
            F.max("slots").alias("n_slots"),
        )
    )
    total = bench.groupBy("item_id").agg(F.count_distinct("item_at").cast("int").alias("n_windows"))
    share = F.col("n_found") / F.col("n_windows")
    return (
        held.join(F.broadcast(total) if small else total, "item_id")
        .filter(share >= least)
        .select(
            "doc_id", "item_id", "n_windows", "n_found", F.round(share, 6).alias("coverage"), "n_slots",
            (F.col("n_exact") / F.col("n_windows") < least).alias("reparameterised"),
        )
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL: dict[str, str] = {}
