"""Lists of citations: numbers as printf writes them, and sources without a name."""

import random

import duckdb
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators.prompts import citation_list, three_places


def test_three_places_against_printf(spark):
    random.seed(1)
    numbers = [i / 16 for i in range(64)] + [i / 1000 + 0.0005 for i in range(2000)] + [round(random.random() * 400, 4) for _ in range(2000)]
    numbers += [random.random() * 10.0**e for e in range(-12, 19) for _ in range(20)] + [0.9995, 9.9995, 234.1925, 2.0**48 + 0.0625, 2.0**62, 5e-324]
    numbers += [-x for x in numbers]
    rows = spark.createDataFrame(list(enumerate(numbers)), "i long, x double")
    got = {r["i"]: r["v"] for r in rows.select("i", three_places(F.col("x")).alias("v")).collect()}
    assert [(x, got[i]) for i, x in enumerate(numbers) if got[i] != f"{x:.3f}"] == []
    assert spark.range(1).select(three_places(F.lit(None).cast("double"))).first()[0] is None


def test_a_citation_without_a_name_keeps_its_line(spark):
    rows = spark.createDataFrame([(1, 1, "a", 2.5), (1, 2, None, 1.0), (1, 3, "b", None)], "query_id long, index int, document_id string, score double")
    assert citation_list(rows).first()["as_text"] == "[1] a (2.500)\n[2]  (1.000)\n[3] b"


def test_citation_lists_against_their_sql(spark, tmp_path):
    """The first question's score is 1.7365, whose binary value lies below; the second one's hits include sources that are null."""
    texts = ["alpha alpha" + " word" * 13] + ["word word gamma"] * 3 + ["word word word"] * 11
    documents = spark.createDataFrame([(i, t, "en", None if i == 2 else f"src{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha"), (2, "gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["query_id"]: (r["as_text"], r["n"]) for r in registry.queries()["citation_lists"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = {q: (text, n) for q, text, n in con.sql(registry.oracle_sql()["citation_lists"]).fetchall()}
    assert want[1][0].startswith("[1] src0 (1.73") and want[2][1] == 3
    assert got == want
