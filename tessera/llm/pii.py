"""Personal data, also where it is disguised, as spans of the source text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, strings, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# An address needs its '@', so that is looked for first; its local part is the run of allowed characters before it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out: list[Span] = []
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def _short(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(map(_short, m[0].split(".")))]


def cards(text: str) -> list[Span]:
    found = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in CARD.finditer(text) if m.end() - m.start() >= 16)
    return [span for span, digits in found if 16 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, leftmost first, none overlapping another of its kind."""
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        out |= {"ip": ips(text), "card": cards(text), "phone": phones(text) if "+" in text else []}
    return out


# Letters of other scripts that look like Latin ones (fixed values)
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹‐‑‒–—−∙․。",
        "ABESIJKMHOPCTYXaeijopcyxsdqwABEZHIKMNOPTYXovp01234567890123456789------...",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
#: Full-width forms and mathematical letters and digits have their plain form as compatibility decomposition.
STRANGE = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～\U0001d400-\U0001d7ff]")
# The digits' names in the languages of the corpus (fixed values)
NAMES = (
    "zero null cero zéro oh",
    "one eins uno un une ein",
    "two zwei dos deux zwo",
    "three drei tres trois",
    "four vier cuatro quatre",
    "five fünf cinco cinq",
    "six sechs seis",
    "seven sieben siete sept",
    "eight acht ocho huit",
    "nine neun nueve neuf",
)
NAME_OF = {name: str(d) for d, names in enumerate(NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(NAME_OF, key=len, reverse=True)) + ")"
#: From three names on, with a plus before them or digits among them.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ \-]+)?{_NAME}(?:[ ,.\-]{{1,2}}(?:{_NAME}|[0-9]+)(?!\w)){{2,}}(?!\w)", re.IGNORECASE)
ITEM = re.compile(r"[^ ,.\-]+")
_AT, _DOT = (rf"[\[({{<]\s*+(?:{words})\s*+[\])}}>]" for words in ("at|arroba|arobase|@|ät", r"dot|punkt|punto|point|\."))
_WORD_AT, _WORD_DOT = "at|arroba|arobase", "dot|punkt|punto|point"
# A connector takes in all white space around it; it is looked for where a run of white space begins, so that each run is read once.
_OPEN = r"(?<!\s)\s*+"
#: '@' and '.', plain, in brackets or as a bare word.
CONNECTOR = re.compile(
    rf"(?P<at>@|{_OPEN}{_AT}\s*+|(?<!\s)\s++(?:{_WORD_AT})\s++)|(?P<dot>\.|{_OPEN}{_DOT}\s*+|(?<!\s)\s++(?:{_WORD_DOT})\s++)",
    re.IGNORECASE,
)
ATOM, LABEL = re.compile(r"[A-Za-z0-9_%+-]++"), re.compile(r"[A-Za-z0-9-]++")
NUMBER = re.compile(r"[0-9]{1,3}(?![0-9])")
# Ends of addresses that are taken where '.' or '@' is a bare word of the language (fixed values)
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev co me tv cc de fr es uk us ca au at ch it nl be pt br mx ar cl eu pl ru se no dk fi ie nz in jp cn kr za".split()
)
BRACKET = re.compile(r"[\[({<]")


class Mapped:
    """A text and, for each of its characters, the span of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, np.arange(len(text)), np.arange(1, len(text) + 1)
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart); what is put in stands for the whole span."""
        if not edits:
            return
        texts, starts, ends, changed, last = [], [], [], [], 0
        for start, end, new in edits:
            texts += [self.text[last:start], new]
            keep = slice(last, start)
            starts += [self.starts[keep], np.full(len(new), self.starts[start])]
            ends += [self.ends[keep], np.full(len(new), self.ends[end - 1])]
            changed += [self.changed[keep], np.ones(len(new), bool)]
            last = end
        self.text = "".join(texts) + self.text[last:]
        self.starts = np.concatenate([*starts, self.starts[last:]])
        self.ends = np.concatenate([*ends, self.ends[last:]])
        self.changed = np.concatenate([*changed, self.changed[last:]])

    def source(self, span: Span) -> Span | None:
        """Where a span comes from; None if no character of it was changed."""
        at = slice(*span)
        whole = int(self.starts[span[0]]), int(self.ends[span[1] - 1])
        # characters that were dropped inside show as a gap
        return whole if self.changed[at].any() or whole[1] - whole[0] != span[1] - span[0] else None


def homoglyphs(m: Mapped) -> None:
    def plain(c: str) -> str:
        if c in INVISIBLE:
            return ""
        return LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)

    m.rewrite([(x.start(), x.end(), plain(x[0])) for x in STRANGE.finditer(m.text)])


def spelled_digits(m: Mapped) -> None:
    edits = []
    for run in SPELLED.finditer(m.text):
        last = None
        for item in ITEM.finditer(m.text, *run.span()):
            word = item[0].lower()
            new = "+" if word == "plus" else NAME_OF.get(word, item[0])
            # what separates two items goes with the later one
            edits.append((item.start() if last is None else last, item.end(), new))
            last = item.end()
    m.rewrite(edits)


def _chains(text: str) -> Iterator[list[re.Match]]:
    """Connectors that follow each other with one atom between them; each is in one chain."""
    chain: list[re.Match] = []
    for x in CONNECTOR.finditer(text):
        if chain and not ATOM.fullmatch(text, chain[-1].end(), x.start()):
            yield chain
            chain = []
        chain.append(x)
    if chain:
        yield chain


def _before(text: str, end: int, allowed: frozenset[str]) -> int:
    """Where the run of allowed characters that ends there begins."""
    while end and text[end - 1] in allowed:
        end -= 1
    return end


ATOM_CHARACTERS = LOCAL - {"."}


def _addresses(text: str, chain: list[re.Match]) -> Iterator[list[re.Match]]:
    """The connectors of each address in a chain: atoms and dots before an at, labels and one dot or more behind it."""
    done = 0
    for k, x in enumerate(chain if len(chain) > 1 else ()):
        if not x["at"]:
            continue
        first = k
        while first > done and chain[first - 1]["dot"]:
            first -= 1
        if k and first == k and done == k:
            # what stands before belongs to the address before
            continue
        begin = _before(text, chain[first].start(), ATOM_CHARACTERS) if first == 0 else chain[first - 1].end()
        if begin == chain[first].start() or (first == 0 and begin and text[begin - 1] == "."):
            continue
        last = k
        while last + 1 < len(chain) and chain[last + 1]["dot"] and LABEL.fullmatch(text, chain[last].end(), chain[last + 1].start()):
            last += 1
        label = LABEL.match(text, chain[last].end())
        if label is None:
            # a dot that nothing follows is the sentence's
            last -= 1
            label = LABEL.match(text, chain[last].end()) if last > k else None
        if label is None or last == k:
            continue
        found = chain[first : last + 1]
        # "at" as a bare word counts only where a dot is disguised too, and bare words only before a known end
        bare = [y for y in found if y[0] not in ".@" and not BRACKET.search(y[0])]
        if any(y["at"] for y in bare) and not any(y["dot"] and y[0] != "." for y in found):
            continue
        if bare and label[0].lower() not in TOP_DOMAINS:
            continue
        done = last + 1
        yield [y for y in found if y[0] not in ".@"]


def _quads(text: str, chain: list[re.Match]) -> Iterator[list[re.Match]]:
    """The connectors of four numbers with dots between them."""
    k = 0
    while k + 2 < len(chain):
        three = chain[k : k + 3]
        begin = _before(text, three[0].start(), frozenset("0123456789"))
        inner = all(NUMBER.fullmatch(text, a.end(), b.start()) for a, b in zip(three, three[1:], strict=False))
        if all(x["dot"] for x in three) and NUMBER.fullmatch(text, begin, three[0].start()) and inner and NUMBER.match(text, three[2].end()):
            yield [x for x in three if x[0] != "."]
            k += 4
        else:
            k += 1


def at_and_dot(m: Mapped) -> None:
    edits = {}
    for chain in _chains(m.text):
        for found in (*_addresses(m.text, chain), *_quads(m.text, chain)):
            edits |= {x.start(): (x.start(), x.end(), "@" if x["at"] else ".") for x in found}
    m.rewrite([edits[at] for at in sorted(edits)])


#: What a text must hold for the step to change anything: a sign in brackets, or a bare word for '.' (a bare "at" counts only beside one).
BRACKETED = re.compile(f"{_AT}|{_DOT}", re.IGNORECASE)
DOT_WORDS = ("dot", "punkt", "punto", "point")
BARE_DOT = re.compile(rf"(?<!\s)\s++(?:{_WORD_DOT})\s", re.IGNORECASE)


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, none overlapping a plain one of its kind.

    The steps after the first need look-alikes put right first, so that all run
    if there are any; without any of what a step changes it is left out.
    """
    strange = not text.isascii() and STRANGE.search(text)
    lower = text.lower()
    named = strange or SPELLED.search(text)
    dotted = strange or BRACKETED.search(text) or (any(w in lower for w in DOT_WORDS) and BARE_DOT.search(text))
    if not (strange or named or dotted):
        return {}
    m = Mapped(text)
    for needed, step in ((strange, homoglyphs), (named, spelled_digits), (dotted, at_and_dot)):
        if needed:
            step(m)
    if m.text == text:
        return {}
    out: dict[str, list[Span]] = {}
    for kind, spans in detect(m.text).items():
        starts, last = [s for s, _ in plain[kind]], 0
        for start, end in sorted(filter(None, map(m.source, spans))):
            # plain spans are in order and apart, and so are those that are added
            k = bisect_left(starts, end)
            if start >= last and (k == 0 or plain[kind][k - 1][1] <= start):
                out.setdefault(kind, []).append((start, end))
                last = end
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, start, end) in code points of the whole text, end exclusive.

    `base` holds what the text shows plainly, `more` what shows once look-alike
    characters, digits spelled as words and disguised '@' and '.' are put right;
    its spans are those of the source. Both are in order of kind, then start.
    Digits' names and the words for '@' and '.' are those of English, German,
    Spanish and French that are listed above; bare words count only before one
    of the listed ends of addresses, or between four numbers. Time grows with
    the text's length, whatever it holds: each run of white space and each chain
    of disguised signs is read once; a text is one string in a task.
    Null text counts as empty; doc_id may be null or repeated; one row a
    document; an empty table gives no rows; further columns are ignored.
    """
    spans = "array<struct<kind:string,start:int,end:int>>"

    def rows(found: dict[str, list[Span]]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in sorted(found.get(k, ()))]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, more = [], []
            for text in strings(batch.column("text")):
                plain = detect(text)
                base.append(rows(plain))
                more.append(rows(disguised(text, plain)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {spans}, more {spans}")


def joined(spans):
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(spans, kind: str):
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    place = F.array(*map(F.lit, KINDS))
    every = F.transform(
        F.array_sort(
            F.transform(F.concat("base", "more"), lambda s: F.struct(F.array_position(place, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select(
        "doc_id",
        *(number("base", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
