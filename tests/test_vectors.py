"""Dense search of both sizes, the inverted file and late interaction against plain models, with ragged, null and equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, products
from tessera.operators import retrieve as R

SCHEMA = "chunk_id long, vector array<double>, label int"


def plain(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = []
        for i, v in vectors:
            if a and v and len(a) == len(v) and all(x is not None and np.isfinite(x) for x in [*a, *v]) and any(a) and any(v):
                x, y = np.array(a), np.array(v)
                scored.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def told(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6) + 0.0) for r in df.collect())


@pytest.fixture
def ragged(spark):
    dice = np.random.default_rng(1)
    vectors = [(i, dice.normal(size=3 if i % 4 else 5).round(2).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[1][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0, 0.0, 0.0]), (2003, [1.0, float("nan"), 0.0]), (2004, [1.0, None, 0.0]), (2005, [1e200, 1e200, 0.0])]
    queries = [(i, v) for i, v in vectors[:30]] + [(77, None), (78, [0.0, 0.0, 0.0]), (79, [1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA).repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    return vectors, queries, frame, asked


@pytest.mark.parametrize("most", [10**6, 0])
def test_vectors_of_unlike_length(ragged, monkeypatch, most):
    vectors, queries, frame, asked = ragged
    monkeypatch.setattr(R, "MOST_NUMBERS", most)
    monkeypatch.setattr(products, "QUERY_BLOCK", 7)
    monkeypatch.setattr(products, "VECTOR_BLOCK", 16)
    vectors = [(i, [1.0, 1.0, 0.0] if i == 2005 else v) for i, v in vectors]
    found = R.dense(frame, asked, 5)
    assert told(found) == plain(vectors, queries, 5)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert R.dense(frame.limit(0), asked).count() == R.dense(frame, asked.limit(0)).count() == 0


def test_ids_that_are_words(spark):
    frame = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, vector array<float>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    assert told(R.dense(frame, asked, 2)) == [("q", 1, "a", 1.0), ("q", 2, "b", 1.0)]


def test_an_index_reads_what_a_query_needs(spark, tmp_path, monkeypatch):
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(40, 16))
    vectors = [(i, (centres[i % 40] + dice.normal(size=16) * 0.08).tolist(), i % 3) for i in range(4000)]
    vectors += [(9000 + i, vectors[0][1], i % 3) for i in range(50)] + [(9999, None, 1), (9998, [0.0] * 16, 1)]
    frame = spark.createDataFrame(vectors, SCHEMA)
    queries = [(i, v) for i, v, _ in vectors[:25]] + [(5000, [1.0]), (5001, None)]
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    index = ann.VectorIndex(spark, f"{tmp_path}/index")
    for _ in range(2):
        index.build(frame)
    hits, report = index.look(asked, 10)
    want = plain([(i, v) for i, v, _ in vectors], queries, 10)
    assert told(hits) == want
    assert max(r["read"] for r in report) <= report[0]["of"] / 4 and len(report) == 25
    assert told(index.search(asked, 10, {"label": 1})) == plain([(i, v) for i, v, x in vectors if x == 1], queries, 10)
    assert told(index.search(asked, 10, {"label": 7})) == []
    few = index.search(asked, 10, probes=4)
    assert ann.recall(few, hits).first()["recall"] >= 0.9
    # blocks of queries
    monkeypatch.setattr(ann, "MOST_NUMBERS", 100)
    assert told(index.search(asked, 10)) == want
    assert index.search(asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.build(frame.unionByName(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)))


def test_late_interaction(spark):
    dice = np.random.default_rng(3)
    docs = [(i, dice.normal(size=(dice.integers(1, 6), 4)).round(2).tolist()) for i in range(1500)] + [(2000, []), (2001, None), (2002, [[1.0, 2.0]])]
    docs += [(3000 + i, docs[0][1]) for i in range(20)]
    asked = [(i, dice.normal(size=(dice.integers(1, 4), 4)).round(2).tolist()) for i in range(9)] + [(50, []), (51, None)]
    want = []
    for q, a in asked:
        scored = sorted((-round(sum(max(float(np.dot(x, y)) for y in d) for x in a), 6), i) for i, d in docs if a and d and len(d[0]) == 4)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    frame = spark.createDataFrame(docs, "chunk_id long, vectors array<array<double>>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, vectors array<array<double>>")
    found = R.top(products.late_interaction(frame, queries, 5).withColumn("score", F.round("score", 6)), 5)
    assert told(found) == sorted(want)
    assert products.late_interaction(frame, queries.limit(0), 5).count() == products.late_interaction(frame.limit(0), queries, 5).count() == 0
