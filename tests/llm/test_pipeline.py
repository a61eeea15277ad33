"""The pipeline's stages against what they are for."""

import re

import corpus_pipeline as P
from tessera.llm import secrets
from tests.conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, DATA))
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # exact copies are gone, benchmark passages and secrets too, clean documents stay as they were
    texts = [r["text"] for r in kept["near_duplicates"]]
    assert len(texts) == len(set(texts))
    assert not any(i in r["text"] for r in kept["decontamination"] for i in items)
    assert all(not secrets.rules(r["text"]) for r in kept["secrets"])
    assert len(kept["secrets"]) == len(kept["decontamination"])
    same = sum(r["text"] == rows[r["doc_id"]]["text"] for r in kept["secrets"])
    assert same > 0.9 * len(kept["secrets"])
    toxic = {i for i, r in rows.items() if re.search(r"\b(idiot|scum|moron|loser|trash)\b", r["text"])}
    assert not {r["doc_id"] for r in kept["mixing"]} - {r["doc_id"] for r in kept["secrets"]}
    assert len(toxic & {r["doc_id"] for r in kept["toxicity"]}) <= len(toxic) / 2
    assert len(kept["toxicity"]) > 0.7 * len(rows)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text", "en", None, 9), (3, "some text", "en", "s", 9), (3, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in P.STAGES:
            out = P.cut(stage(spark, out, DATA))
            ids = [r["doc_id"] for r in out.collect()]
            if name == "near_duplicates" and given is docs:
                assert sorted(ids, key=str) == [1, 3]


def test_rows_without_or_with_repeated_ids(spark):
    """Each row is judged by its own text; columns whose names the stages use themselves come through."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 80").orderBy("item_id").first()["text"]
    texts = [(1, "aaa bbb ccc ddd eee fff ggg"), (1, "zzz yyy xxx www vvv uuu ttt"), (None, f"some words {item} and more"), (None, "a clean text that stays as it is"), (1, item)]
    clash = "copy_rank text_key row label key fp rate times of_source of node h item_id at kind".split()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[77] * len(clash)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    for _, stage in P.STAGES[1:4]:
        docs = P.cut(stage(spark, docs, DATA))
    assert sorted((tuple(r) for r in docs.collect()), key=str) == sorted(((i, t, "en", "s", len(t), *[77] * len(clash)) for i, t in (texts[0], texts[1], texts[3])), key=str)
    assert P.mix(spark, docs, DATA).columns == [*docs.columns, "copy", "shuffle_key"]


def test_run(spark):
    out = P.run(spark, DATA)
    assert {"doc_id", "text", "copy", "shuffle_key"} <= set(out.columns) and out.count() > 20
