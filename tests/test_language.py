"""Languages by groups of characters: held-out accuracy, also without the words that every text has, and awkward rows."""

from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.functions.language import LanguageModel, by_line


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) >= 20")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    detect = LanguageModel.fit(docs.filter(~held)).detect(spark)
    common = "|".join(sorted({w for ws in tokens.PROFILES.values() for w in ws}))
    for text in (F.col("text"), F.regexp_replace(F.lower("text"), rf"\b({common})\b", " "), F.substring("text", 1, 300)):
        right, n = docs.filter(held).agg(F.count_if(detect(text)["language"] == F.col("lang")), F.count(F.lit(1))).first()
        assert n > 300 and right / n >= 0.98


def test_awkward_texts(spark):
    docs = spark.createDataFrame([(1, "the thing that was there", "en"), (2, "das Ding, das dort war", "de"), (3, None, "de"), (4, "", "fr"), (5, "no language here at all", None)], "doc_id long, text string, lang string")
    model = LanguageModel.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame([(1, "that was the thing, there it was"), (2, "das war das Ding, dort war es"), (3, None), (4, "short"), (5, "😀" * 30), (6, "the thing that was " * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["d"]["language"], r["d"]["share"]) for r in asked.select("doc_id", model.detect(spark)(F.col("text")).alias("d")).collect()}
    assert got[1][0] == got[6][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("en", 0.5)
    nothing = LanguageModel.fit(docs.limit(0))
    assert nothing.languages == [] and {r["d"]["language"] for r in asked.select(nothing.detect(spark)(F.col("text")).alias("d")).collect()} == {"en"}
    lines = spark.createDataFrame([(1, "that was the thing, there it was, and that was the thing that was there\n  das war das Ding, dort war es, und das war das Ding, das dort war  \nshort")], "doc_id long, text string")
    assert sorted(tuple(r) for r in by_line(lines, model).collect()) == [(1, "de", 1, 0.5), (1, "en", 1, 0.5)]
