"""The pipeline's stage of near-duplicates links by fingerprints as well as by similarity."""

import random

import corpus_pipeline as P
from tessera.llm import simhash
from tests.conftest import DATA


def test_both_relations_and_chains(spark):
    dice = random.Random(11)
    words = lambda n: [f"w{dice.randrange(10**6)}" for _ in range(n)]
    base, other = words(400), words(400)
    repeated = words(12)
    # 1 and 2 have the same shingles but other counts: fingerprints far apart, sets alike; 3 has 5 in 6 of them
    texts = [(1, base), (2, base + repeated * 100), (3, base[:345] + words(55)), (4, other), (5, other[:399] + words(1)), (6, words(300))]
    # a case that only fingerprints link: one sentence many times over, then other words behind it
    line = words(40)
    texts += [(7, line * 50 + words(20)), (8, line * 50 + words(20))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    fps = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    sets = {r["doc_id"]: r["label"] for r in simhash.similar_texts(docs).collect()}
    assert fps[7] == fps[8] and sets[7] != sets[8] and sets[1] == sets[2] and fps[1] != fps[2]
    kept = sorted(r["doc_id"] for r in P.one_of_each_group(spark, docs, DATA).collect())
    classes = {i: i for i, _ in texts}
    for relation in (fps, sets):
        for a in classes:
            for b in classes:
                if relation[a] == relation[b]:
                    old, new = max(classes[a], classes[b]), min(classes[a], classes[b])
                    classes = {i: new if c == old else c for i, c in classes.items()}
    assert kept == sorted(set(classes.values())) and 8 not in kept
