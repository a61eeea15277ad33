"""Tokenizers, sentence splitting, hashes and language as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.let import once

# Words that overlap metrics ignore (fixed values)
METRIC_STOPWORDS = (
    "a an the and or but in on at to for of with by from that this is are was were be been have has had do does did will would could "
    "should may might can what when where who why how which"
).split()
# Words that grounding ignores (fixed values)
GROUNDING_STOPWORDS = (
    "a an the and or but in on at to for of with by from that this is are was were be been being have has had do does did will would "
    "could should may might shall can what when where who why how which whom whose these those it its they them their"
).split()


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


#: Two ASCII letters or digits or more that no other letter, digit or underscore touches.
BM25_TOKEN = r"(?<![\p{L}\p{N}_])[a-z0-9]{2,}+(?![\p{L}\p{N}_])"


def bm25_tokens(text: Column) -> Column:
    """ASCII words of two characters or more; no stop words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(BM25_TOKEN), 0)


def counted_terms(tokens: Column) -> Column:
    """(term, tf) of each different token, in order."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        new = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        starts = F.when(n > 0, new).otherwise(F.array().cast("array<int>"))
        return once(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).alias("tf"))))

    return once(F.sort_array(tokens), of)


def bm25_length(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(BM25_TOKEN))


def _content_words(text: Column, stopwords: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_'-]+"), 0)
    # what leads or trails a word is not part of it
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"^[-'_]+|[-']+$", ""))
    return F.filter(bare, lambda x: x.rlike("^[a-z0-9][a-z0-9'-]*$") & (F.length(x) >= 3) & ~x.isin(*stopwords))


def metric_tokens(text: Column) -> Column:
    return F.array_distinct(_content_words(text, METRIC_STOPWORDS))


def grounding_tokens(text: Column) -> Column:
    return _content_words(text, GROUNDING_STOPWORDS)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def quarter_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def model_tokens(text: Column) -> Column:
    """A model's tokens by the usual four characters each; one at least, none for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), quarter_tokens(text)))


# The pattern is a fixed value.
#: A sentence ends by .!? before white space and a capital or an opening mark, but not after "e.g." or "Mr.".
SENTENCE_END = "(?<!\\w\\.\\w.)(?<![A-Z][a-z]\\.)(?<=[.!?])\\s+(?=[A-Z\"‘“¿¡])"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), lambda x: F.regexp_replace(x, r"\A\s++|(?<!\s)\s++\z", "")), lambda x: x != "")


def answer_sentences(text: Column) -> Column:
    """Sentences of an answer without its citations, from ten characters on."""
    bare = F.regexp_replace(text, r"\[\d+(?:[-,]\d+)*\]", "")
    parts = F.split(bare, '(?<=[.!?])\\s+(?=[A-Z"])|(?<=\\.)\\n+(?=[A-Z"])|(?<=\\n\\n)', -1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"\A\s++|(?<!\s)\s++\z", "")), lambda x: F.length(x) >= 10)


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


# Frequent short words of the languages that are told apart (fixed values)
PROFILES = {
    "en": "the and of to in is that for it with as was on are by this be at from".split(),
    "fr": "le la les de des et en un une que qui est dans pour pas sur du au avec ce".split(),
    "de": "der die das und in zu den mit von ist im nicht ein eine auf sich dem des als".split(),
    "es": "el la los de y en que un una por con para se del las es al lo como su".split(),
}


# Codes and names of languages (fixed values)
LANGUAGES = {
    "af": "Afrikaans", "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "ca": "Catalan", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English",
    "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French", "gu": "Gujarati", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian",
    "id": "Indonesian", "it": "Italian", "ja": "Japanese", "kn": "Kannada", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian", "mk": "Macedonian", "ml": "Malayalam", "mr": "Marathi",
    "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "pa": "Punjabi", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian",
    "so": "Somali", "sq": "Albanian", "sr": "Serbian", "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "te": "Telugu", "th": "Thai", "tl": "Filipino", "tr": "Turkish",
    "uk": "Ukrainian", "ur": "Urdu", "vi": "Vietnamese", "zh-cn": "Chinese (Simplified)", "zh-tw": "Chinese (Traditional)", "zh": "Chinese",
}


def language_name(code: Column) -> Column:
    """The language's name, or the code itself if it has none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[code], code)


def is_supported(code: Column) -> Column:
    return code.isin(*LANGUAGES)


def language(text: Column, least: int = 20) -> Column:
    """(language, share): the language most of whose frequent words occur, and its share of all hits; en and 0.5 for short texts."""

    def hits(found: Column) -> Column:
        return F.array(
            *(
                F.struct(F.size(_of(found, ws)).alias("n"), F.lit(-i).alias("place"), F.lit(code).alias("code"))
                for i, (code, ws) in enumerate(PROFILES.items())
            )
        )

    def judged(counts: Column) -> Column:
        best = F.array_max(counts)
        total = F.aggregate(counts, F.lit(0), lambda s, h: s + h["n"])
        known = (F.length(text) >= least) & (total > 0)
        return F.struct(
            F.when(known, best["code"]).otherwise("en").alias("language"),
            F.when(known, F.round(best["n"] / total, 4)).otherwise(F.lit(0.5)).alias("share"),
        )

    every = [w for ws in PROFILES.values() for w in ws]
    # first what is in any profile, then whose it is
    return once(once(_of(words(text), sorted(set(every))), hits), judged)


def _of(found: Column, listed: list[str]) -> Column:
    return F.filter(found, lambda x: x.isin(*listed))


# Signs of programming languages, in order of preference (fixed values)
CODE_SIGNS = (
    ("python", r"\bdef \w+\(|import \w+|print\(|if __name__"),
    ("javascript", r"function\s+\w+\s*\(|const\s+\w+\s*=|let\s+\w+|=>\s*\{"),
    ("typescript", r"interface\s+\w+|type\s+\w+\s*=|:\s*string|:\s*number|tsx?$"),
    ("sql", r"\bselect\b.+\bfrom\b|\bcreate\s+table\b|\binsert\s+into\b"),
    ("go", r"\bpackage\s+\w+|\bimport\s+\"|\bfunc\s+\w+\s*\("),
    ("rust", r"\bfn\s+\w+\s*\(|let mut\s+\w+|impl\s+\w+\s*\{|use\s+\w+::"),
)


def code_language(text: Column) -> Column:
    sample = F.lower(F.substring(text, 1, 2000))
    return F.coalesce(*(F.when(sample.rlike(sign), name) for name, sign in CODE_SIGNS), F.lit("generic"))


def looks_like_code(text: Column) -> Column:
    sample = F.substring(text, 1, 1000)
    signs = (
        sample.rlike(r"(?m)^\s*(def|class|import|from)\s+\w+"),
        sample.rlike(r"(?m)^\s*(function|const|let|var)\s+\w+"),
        sample.rlike(r"(?mi)^\s*(SELECT|CREATE|INSERT|UPDATE)\s+\w+"),
        (F.regexp_count(sample, F.lit(r"\{")) > 5) & (F.regexp_count(sample, F.lit(r"\}")) > 5),
    )
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 2
