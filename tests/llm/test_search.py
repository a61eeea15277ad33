"""Hard negatives, ranked lexical search and license scans against brute force, with nulls, ties, copies, long texts and clashing names."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, licenses, negatives, registry, vectors

LONG = " ".join(f"word{i % 97} and {i * 7919 % 1009}" for i in range(30_000))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        path = f"{data}/{t}.parquet"
        duck.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = registry.queries()[name](spark, data)
    result = duck.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    place = [result.columns.index(c) for c in names]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(result.columns) == names
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())


# 11


@pytest.mark.parametrize("dim", [1, 3, 64, 70])
@pytest.mark.parametrize("turns", [1, 8])
def test_intervals_hold(dim, turns):
    dice = np.random.default_rng(dim)
    frame = negatives.directions(dim, turns)
    rows = np.floor(dice.normal(size=(300, dim)) * np.exp(dice.normal(size=(300, 1)) * 4))
    rows[:3] = 0
    rows[3:40] = np.floor(rows[60:61] * 3 + dice.normal(size=(37, dim)))
    queries = np.concatenate([rows[50:90], np.zeros((1, dim)), np.ones((1, dim)) * 1e9])
    low, high = negatives.Asked(queries, frame).intervals(negatives.Codes(rows, frame))
    scores = queries @ rows.T
    assert (low <= scores).all() and (scores <= high).all()
    huge = np.full((2, dim), 1e200)
    low, high = negatives.Asked(huge, frame).intervals(negatives.Codes(huge, frame))
    assert not (high < 0).any()


def brute_negatives(rows, positives=5, k=3):
    """rows: (vec_id, label, whole numbers)."""
    first = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and (i not in first or (label, v) < first[i]):
            first[i] = (label, v)
    out = []
    for a in (i for i in first if i % 50 == 0):
        scores = [(-sum(int(x) * int(y) for x, y in zip(first[a][1], v, strict=True)), i, label) for i, (label, v) in first.items() if i != a]
        scores.sort()
        for s, p, _ in [x for x in scores if x[2] == first[a][0]][:positives]:
            fit = [x for x in scores if x[2] != first[a][0] and 50 * -s <= 100 * -x[0] <= 95 * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, **more):
    schema = "vec_id long, label int, v array<double>, score string, rank int"
    df = spark.createDataFrame([(i, label, v, "x", 7) for i, label, v in rows], schema)
    return Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def test_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 64)
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(6, 12)) * 100
    rows = []
    for i in range(1200):
        # a third of all has one label, a tenth are copies of one vector
        label = 0 if i % 3 == 0 else int(dice.integers(0, 5))
        v = centres[label] + dice.normal(size=12) * 60 if i % 10 else centres[0]
        rows.append((i, label, np.floor(v).tolist()))
    rows += [(7, 1, rows[7][2]), (7, 0, rows[9][2]), (50, 3, rows[11][2]), (None, 1, rows[1][2]), (5000, None, rows[1][2]), (5001, 1, None), (5050, 4, [0.0] * 12), (5051, 4, [0.0] * 12), (5052, 2, [0.0] * 12)]
    want = brute_negatives(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    assert mined(spark, rows, turns=1, query_block=5) == want


def test_negatives_of_large_components(spark):
    dice = random.Random(4)
    rows = [(i, i % 3 % 2, [float(dice.randrange(1, 10**9)) for _ in range(5)]) for i in range(200)]
    # their products leave 64 bits, but are far below all positives and negatives
    rows += [(1001, 0, [-1e17, 0.0, 0.0, 0.0, 0.0]), (1003, 1, [-1e200, -1e200, 0.0, 0.0, 0.0]), (1004, 0, [-1e300] * 5)]
    want = brute_negatives(rows)
    assert len(want) > 20 and max(x[4] for x in want) > 2**53
    assert mined(spark, rows) == want
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [1e10]), (1, 1, [1e10])])


def test_negatives_of_nothing(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])])
    assert not mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])])
    # a positive of zero has negatives of zero, one below zero none
    assert mined(spark, [(0, 1, [0.0]), (1, 1, [3.0]), (2, 2, [5.0]), (50, 3, [1.0]), (51, 3, [-1.0]), (52, 4, [-0.75])]) == Counter({(0, 1, 1, 2, 0, 0): 1, (0, 1, 2, 50, 0, 0): 1, (0, 1, 3, 51, 0, 0): 1})


def test_whole_numbers(spark):
    rows = [([0.5, -0.001, 1e30],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([1e308],)]
    df = spark.createDataFrame(rows, "e array<double>").select(vectors.whole(F.col("e")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[128.0, -1.0, 256e30], None, None, None, None, [], None]


# 12


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    held = [(i, Counter(brute_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            score = 0
            m = 25 + 75 * sum(c.values()) * n // total
            for t in brute_terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, term int, score string").repartition(3)
    b = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return Counter(tuple(r) for r in lexical.search(d, b, **more).collect())


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "two words"), (6, LONG), (7, LONG), (7, LONG), (None, "no id here at all"), (None, "no id here at all"), (8, "naïve ÜNÏCODE — “quotes” 😀 é"), (9, "\x00nul\x00and_under[brackets]`x~y")]


def test_search_against_all_scores(spark):
    dice = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"R{i}" for i in range(400)]
    docs = [(i, " ".join(dice.choices(common, k=dice.randrange(60)) + dice.choices(rare, k=dice.randrange(8)))) for i in range(900)]
    docs += [(2000 + i, docs[3][1]) for i in range(300)] + AWKWARD
    items = [(i, " ".join(dice.choices(common, k=3) + dice.choices(rare, k=3))) for i in range(15)]
    items += [(50, docs[3][1]), (51, None), (52, "nothing known"), (53, "c1 C1 c1"), (54, "ünïcode ÜNÏCODE naïve no word5 nul under x"), (54, "id here"), (55, "c0 c1 c2 c3 c4 c5 c6 c7 c8 c9")]
    want = brute_search(docs, items)
    assert searched(spark, docs, items) == want
    # many segments, and a block for each item
    assert searched(spark, docs, items, segment_bytes=9000, block_bytes=1) == want
    assert searched(spark, docs, [], k=3) == searched(spark, [], items) == searched(spark, AWKWARD[:3], items) == Counter()


def test_runs_are_skipped(spark):
    dice = random.Random(9)
    docs = [(i, " ".join(dice.choices("abcdefgh", k=30)) + (" rare" * 9 if i == 77 else " gold" if i < 40 else "")) for i in range(20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    b = spark.createDataFrame([(1, "gold a b")], "item_id long, text string")
    read, skipped = map(sum, zip(*lexical.search(d, b, counted=True).collect(), strict=True))
    assert skipped > 10 * read


# 13


def brute_licenses(docs):
    templates = licenses.templates_of(licenses.TEMPLATES, licenses.THRESHOLD)
    out = []
    for i, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        more = defaultdict(float)
        for t in templates:
            for start in range(0, len(words), t.half):
                overlap = len(set(words[start : start + 2 * t.half]) & set(t.words))
                if overlap >= licenses.THRESHOLD * len(t.words) - 1e-9:
                    more[t.label] = max(more[t.label], overlap / len(t.words))
        labels = {x for _, x in base}
        score = 1.0 if base else max(more.values(), default=0.0)
        at = [p for p, _ in base]
        out.append((i, len(words), len(base), min(at, default=None), max(at, default=None), sorted(labels), sorted(labels | set(more)), round(score, 9)))
    return Counter(map(str, out))


def scanned(spark, docs, **more):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, label string, row int").repartition(3)
    return Counter(str((*(list(x) if isinstance(x, list) else x for x in r[:-1]), round(r[-1], 9))) for r in licenses.scan_licenses(d, **more).collect())


def test_licenses_against_all_blocks(spark):
    dice = random.Random(2)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.plain_words(t)}) + [f"w{i}" for i in range(100)]
    docs = [(i, t) for i, t in enumerate([None, "", "  ", LONG, LONG, "CC by by cc BY-nc", "all rights reserved. ALL Rights\nReserved all rights", "the Kind all rightſ reserved", "naïve general public LICENSE É 😀"])]
    docs += [(None, "general public license"), (3, "all rights reserved")]
    for label, text in licenses.TEMPLATES:
        words = text.split()
        for cut in (0, 1, 2, len(words) // 5):
            left = words[:]
            for _ in range(cut):
                left.pop(dice.randrange(len(left)))
            for _ in range(dice.randrange(4)):
                left.insert(dice.randrange(len(left) + 1), "OTHER")
            before = dice.choices(vocabulary[-100:], k=dice.randrange(300))
            docs.append((len(docs), " ".join(before + left + before[:50])))
    docs += [(len(docs) + i, " ".join(dice.choices(vocabulary, k=400))) for i in range(60)]
    want = brute_licenses(docs)
    assert scanned(spark, docs) == want
    assert scanned(spark, []) == Counter()


def test_license_blocks(spark):
    text = "x " * 1000 + dict(licenses.TEMPLATES)["bsd"] + " y" * 1000
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = licenses.license_blocks(docs).collect()
    assert {(r["doc_id"], r["label"], r["containment"]) for r in got} == {(1, "bsd", 1.0)}
    assert all(r["start"] <= 1000 and r["start"] + r["n_words"] >= 1000 + 20 for r in got)
    assert licenses.license_blocks(docs, []).count() == 0
    with pytest.raises(ValueError):
        licenses.license_blocks(docs, threshold=0)
