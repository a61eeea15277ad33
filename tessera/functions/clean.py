"""Text cleaning as column expressions, in stages that can be added to."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.let import once

Stage = Callable[[Column], Column]

# Characters that are written out or made plain (fixed values)
REPLACED = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
    "’": "'",
    "‘": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "--",
    "…": "...",
    " ": " ",
}
# Phrases that address a model instead of a reader (fixed values)
INJECTIONS = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions?",
    r"(?i)you\s+are\s+now\s+(a|an|the)\s+\w+",
    r"(?i)forget\s+(all\s+)?your\s+(previous\s+)?(instructions?|training|rules)",
    r"(?i)new\s+system\s+prompt\s*:",
    r"(?i)(developer|jailbreak|dan|god|unrestricted)\s+(mode|prompt|instructions?)",
    r"(?i)<\|?(system|user|assistant|im_start|im_end)\|?>",
    r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>",
    r"(?i)act\s+as\s+(if\s+)?(you\s+are\s+)?a[n]?\s+\w+\s+(without|with no)\s+(restriction|filter|limit)",
    r"(?i)print\s+(your\s+)?(system|initial|original)\s+prompt",
    r"(?i)reveal\s+(your\s+)?(system|internal|secret)\s+(prompt|instruction)",
    r"(?i)do\s+not\s+(follow|obey|adhere\s+to)\s+(the\s+)?(previous|above|prior)\s+(instruction|rule|guideline)",
)
REDACTED = "[INJECTION-REDACTED]"


# What a phrase needs in lower case: one word of each group (fixed values)
NEEDED = (
    (("ignore",), ("previous",), ("instruction",)),
    (("you",), ("are",), ("now",)),
    (("forget",), ("your",), ("instruction", "training", "rules")),
    (("new",), ("system",), ("prompt",), (":",)),
    (("mode", "prompt", "instruction"), ("developer", "jailbreak", "dan", "god", "unrestricted")),
    (("<",), ("system", "user", "assistant", "im_start", "im_end")),
    (("[inst]", "[/inst]", "<<sys>>", "<</sys>>"),),
    (("restriction", "filter", "limit"), ("without", "with no"), ("act",)),
    (("print",), ("prompt",), ("system", "initial", "original")),
    (("reveal",), ("prompt", "instruction"), ("system", "internal", "secret")),
    (("follow", "obey", "adhere"), ("do",), ("not",), ("instruction", "rule", "guideline")),
)
#: What \s and Java's patterns take for white space.
SPACES = " \t\n\x0b\f\r"


def where(text: Column, needed: Callable[[Column], Column], change: Stage) -> Column:
    """The change where the text has what it needs: a plain search costs a small part of a pattern."""
    return once(text, lambda t: F.when(needed(t), change(t)).otherwise(t))


def has(*parts: str) -> Callable[[Column], Column]:
    """Whether a text holds one of the parts."""
    return lambda t: reduce(or_, (t.contains(p) for p in parts))


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    def plain(t: str) -> str:
        t = unicodedata.normalize("NFC", t)
        for old, new in REPLACED.items():
            t = t.replace(old, new)
        return t

    return text.map(plain, na_action="ignore")


def newlines(text: Column) -> Column:
    return where(text, has("\r"), lambda t: F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def compose(text: Column) -> Column:
    """NFC, for which Spark has no function, and plain characters for those of REPLACED; plain ASCII does not go to Python."""
    return F.when(beyond_ascii(text), _composed(F.when(beyond_ascii(text), text))).otherwise(text)


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def unicode(text: Column) -> Column:
    return without_controls(compose(text))


def whitespace(text: Column) -> Column:
    # these patterns are fixed values
    text = where(text, beyond_ascii, lambda t: F.regexp_replace(t, "[  -   　]", " "))
    text = where(text, has("  "), lambda t: F.regexp_replace(t, " {2,}", " "))
    ends = lambda t: reduce(or_, (t.contains(f"{c}\n") | t.endswith(c) for c in SPACES if c != "\n"))
    text = where(text, ends, lambda t: F.regexp_replace(t, r"(?<![^\S\n])[^\S\n]++(\n|\z)", "$1"))
    text = where(text, has("\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return F.btrim(text, F.lit(SPACES))


def ocr_artifacts(text: Column) -> Column:
    """Join words cut by a hyphen at the line's end, drop dashed page numbers and ruled lines, join three spaced letters."""
    # these patterns are fixed values
    text = where(text, has("-\n"), lambda t: F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2"))
    text = where(text, lambda t: t.contains("-") & t.rlike(r"-\s*+\d{1,4}\s*-"), lambda t: F.regexp_replace(t, r"(?m)^\s*-\s*\d{1,4}\s*-\s*$", ""))
    text = where(text, lambda t: t.rlike(r"[|_\-=~]{5}"), lambda t: F.regexp_replace(t, r"(?m)^[|_\-=~]{5,}\s*$", ""))
    return where(text, lambda t: t.rlike(r" [A-Za-z] [A-Za-z](?![A-Za-z0-9_])"), lambda t: F.regexp_replace(t, r"(?U)\b([A-Za-z]) ([A-Za-z]) ([A-Za-z])\b", "$1$2$3"))


# Words that recognition of print confuses (fixed values)
WORD_FIXES = ((r"\bRll\b", "All"), (r"\bHl\b", "Hi"), (r"\b1\b(?=\s+[a-z])", "I"), (r"(?<=\w)rn(?=\w)", "m"), (r"\bII\b(?!\w)", "ll"))


def ocr_words(text: Column) -> Column:
    """Words put right that print recognition confuses: a stage of one's own choice, as it changes words that are right too."""
    for pattern, word in WORD_FIXES:
        text = F.regexp_replace(text, pattern, word)
    return text


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def page_numbers(text: Column) -> Column:
    # what a line of a page number alone is (fixed value)
    number = r"^(\d{1,5}|[-(\[]*\s*\d{1,5}\s*[-)\]]*|[Pp]age\s+\d+(\s+of\s+\d+)?)$"
    return F.array_join(F.filter(_lines(text), lambda x: ~F.trim(x).rlike(number)), "\n")


def headers_and_footers(text: Column) -> Column:
    """Of texts of ten lines or more, drop short lines that recur three times and in a quarter of the lines.

    Lines are counted by sorting them: a line is one of `k` equal ones if the
    line k - 1 places after its first place in the sorted array is equal.
    """

    def judged(lines: Column) -> Column:
        needed = F.greatest(F.lit(3), F.ceil(F.size(lines) * 0.25)).cast("int")

        def frequent(ordered: Column) -> Column:
            ahead = F.slice(ordered, needed, F.greatest(F.size(ordered) - needed + 1, F.lit(0)))
            pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - needed + 1, F.lit(0))), ahead, lambda a, b: F.when(a == b, a))
            return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull() & (F.length(x) > 3) & (F.length(x) < 120)))

        def without(often: Column) -> Column:
            kept = F.array_join(F.filter(lines, lambda x: ~F.array_contains(often, F.trim(x))), "\n")
            return F.when(F.size(often) > 0, kept).otherwise(F.array_join(lines, "\n"))

        return F.when(F.size(lines) < 10, F.array_join(lines, "\n")).otherwise(once(once(F.array_sort(F.transform(lines, lambda x: F.trim(x))), frequent), without))

    return once(_lines(text), judged)


def empty_lines(text: Column) -> Column:
    """Without the lines of white space that begin and end the text; the runs are cut off first, so that time is in proportion to them."""

    def first(t: Column, body: Column) -> Column:
        return F.concat(F.substring_index(F.substr(t, F.lit(1), F.length(t) - F.length(body)), "\n", -1), body)

    def last(t: Column, body: Column) -> Column:
        return F.concat(body, F.substring_index(F.substr(t, F.length(body) + 1), "\n", 1))

    text = once(text, lambda t: once(F.ltrim(t, F.lit(SPACES)), lambda body: first(t, body)))
    return once(text, lambda t: once(F.rtrim(t, F.lit(SPACES)), lambda body: last(t, body)))


def injections(text: Column) -> Column:
    marker = REDACTED.replace("[", r"\[").replace("]", r"\]")

    def replaced(lower: Column) -> Column:
        # what a phrase needs is looked for in the text as it came: no phrase can begin or end in the marker
        out = text
        for pattern, groups in zip(INJECTIONS, NEEDED, strict=True):
            out = where(out, lambda _, g=groups: reduce(and_, (has(*words)(lower) for words in g)), lambda t, p=pattern: F.regexp_replace(t, p, marker))
        return out

    return once(F.lower(text), replaced)


def injection_count(text: Column) -> Column:
    return sum((text.rlike(p).cast("int") for p in INJECTIONS), F.lit(0))


#: The default order.
STAGES: tuple[tuple[str, Stage], ...] = (
    ("newlines", newlines),
    ("unicode", unicode),
    ("ocr_artifacts", ocr_artifacts),
    ("whitespace", whitespace),
    ("page_numbers", page_numbers),
    ("headers_and_footers", headers_and_footers),
    ("empty_lines", empty_lines),
    ("injections", injections),
)


def clean_column(df: DataFrame, column: str, stages: tuple[tuple[str, Stage], ...] = STAGES) -> DataFrame:
    """All stages on a column, one after another; a pipeline of one's own is a longer or shorter tuple."""
    for _, stage in stages:
        if stage is unicode:
            # the one step in Python stands alone, so that the others compile as one
            df = df.withColumn(column, compose(F.col(column)))
            stage = without_controls
        df = df.withColumn(column, stage(F.col(column)))
    return df
