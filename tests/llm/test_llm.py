"""The training-data operators against brute force on small tables with nulls, ties, copies and clashing names."""

import hashlib
import html as stdlib_html
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, components, crf, decontaminate, html, mixing, pii, planted, registry, secrets, shingles, simhash, suffixes, topk, toxicity

LONG = " ".join(f"word{i % 97} and {i * 7919 % 1009}" for i in range(30_000))


def texts_of(spark, rows):
    """Documents with a further column whose name an operator uses too."""
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "two words"), (6, LONG), (7, LONG), (7, LONG), (None, "no id here at all"), (8, "naïve ünïcode — “quotes” 😀")]


# 10


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """{doc_id: least doc_id} by a union of all pairs."""
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.queries()["op10_simhash"](spark, data).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(texts_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[6]["component_id"] == by[7]["component_id"] == 6
    assert simhash.near_duplicates(texts_of(spark, [])).collect() == []


def test_links_lose_nothing_over_tiles(spark):
    dice = random.Random(5)
    base = [dice.getrandbits(64) for _ in range(150)]
    prints = {i: b for i, b in enumerate(base)}
    for i in range(150, 700):
        prints[i] = prints[dice.randrange(i)]
        for _ in range(dice.randrange(5)):
            prints[i] ^= 1 << dice.randrange(64)
    rows = spark.createDataFrame([(i, p - (1 << 64) * (p >> 63)) for i, p in prints.items()], "doc_id long, fp long")
    edges = simhash.links(rows, 3, group=120)
    label = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    groups = defaultdict(set)
    for r in rows.collect():
        groups[label.get(r["fp"], r["fp"])].add(r["doc_id"])
    want = defaultdict(set)
    for i, c in brute_components(prints).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def brute_classes(docs, words=5, similarity=0.8):
    """{doc_id: least doc_id} by the Jaccard similarity of all pairs."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


def test_similar_texts_against_all_pairs(spark):
    """Pairs alike to just over and just under the bound, repeated lines, a chain, a large group and texts of few words."""
    dice = random.Random(11)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    def spoilt(words, similarity, base):
        """Words at the end replaced so that the sets are alike to about that."""
        n = len(words) - 4
        same = round(2 * n * similarity / (1 + similarity))
        return [*words[: same + 4], *(f"n{base}x{k}" for k in range(len(words) - same - 4))]

    for p in range(160):
        words = [f"w{dice.randrange(5000)}" for _ in range(dice.choice((120, 304, 1004)))]
        add(words)
        add(spoilt(words, dice.uniform(0.8, 0.85) if p % 2 else dice.uniform(0.7, 0.799), p))
    for p in range(20):
        words = [f"r{p}x{k}" for k in range(300)]
        add(words)
        add(words + [f"junk{p}x{k}" for k in range(12)] * 100)
    chain = [f"c{k}" for k in range(204)]
    for k in range(6):
        add(chain[k * 15 :] + [f"d{j}" for j in range(k * 15)])
    group = [f"g{k}" for k in range(300)]
    for k in range(60):
        add([*group[: 5 * k], f"o{k}", *group[5 * k + 1 :]])
    for t in ("one", "one two", "One  TWO", "a b c d e", "a b c d f"):
        add(t.split(" "))
    docs = texts_of(spark, rows)
    want = brute_classes(rows)
    assert least_of_classes(simhash.similar_texts(docs).collect()) == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each_class(docs).collect()) == sorted(set(want.values()))
    empty = simhash.similar_texts(texts_of(spark, AWKWARD)).collect()
    assert len(empty) == len(AWKWARD) and len({r["label"] for r in empty if r["doc_id"] in (1, 2, 3)}) == 1
    assert simhash.similar_texts(texts_of(spark, [])).collect() == []


def least_of_classes(rows):
    least = {}
    for r in rows:
        least[r["label"]] = min(least.get(r["label"], r["doc_id"]), r["doc_id"])
    return {r["doc_id"]: least[r["label"]] for r in rows}


def test_a_bucket_of_unlike_texts(spark):
    """Texts that share most of a long passage, so that bands agree, in many classes of which some are alike."""
    dice = random.Random(3)
    common = [f"c{k}" for k in range(150)]
    rows = []
    for i in range(120):
        own = [f"o{i // 3}x{k}" for k in range(70)]
        for _ in range(i % 3):
            own[dice.randrange(70)] = f"new{i}"
        rows.append((i, " ".join([*common, *own])))
    docs = texts_of(spark, rows)
    assert least_of_classes(simhash.similar_texts(docs).collect()) == brute_classes(rows)


def test_tiles_of_bitmaps_against_all_pairs(spark):
    dice = np.random.default_rng(4)
    pool = dice.integers(0, 1 << 63, 900, np.uint64)
    sets = [np.unique(dice.choice(pool[: dice.integers(30, 900)], dice.integers(1, 60))) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: max(1, len(s) * 9 // 10)], dice.choice(pool, 2)])) for s in sets]
    labels = np.arange(len(sets)) // 2 * 2
    for sides in (None, np.arange(len(sets)) < 65):
        got = shingles.tile_links(sets, labels, sides, 0.8, block=40)
        assert all(shingles.jaccard(sets[i], sets[j]) >= 0.8 for i, j in got)
        classes = []
        for links in (got, [(i, j) for i in range(len(sets)) for j in range(i) if shingles.jaccard(sets[i], sets[j]) >= 0.8 and (sides is None or sides[i] != sides[j])]):
            up = np.arange(len(sets))
            u, v = np.array([*links, *((i, i + 1) for i in range(0, len(sets), 2))]).T
            components.union(up, u, v)
            classes.append(up.tolist())
        assert classes[0] == classes[1] and len(got) > 20
    rows = [(1, i, len(x), int(y), x.tobytes()) for i, (x, y) in enumerate(zip(sets, labels, strict=True))]
    df = spark.createDataFrame(rows, "band long, key long, n int, label long, shingles binary")
    found = []
    for tile in (10**6, 300):
        up = np.arange(len(sets))
        u, v = np.array([*((r["u"], r["v"]) for r in shingles.linked(df, 0.8, tile).collect()), *((i, i + 1) for i in range(0, len(sets), 2))]).T
        components.union(up, u, v)
        found.append(up.tolist())
    assert found[0] == found[1]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = ("aaa " * 3 + "b c d e f g h").strip(), "zzz y x w v u t s r q"
    rows = [(1, a, "f1", 77), (1, b, "f2", 78), (None, b + " ", "f3", 79), (None, "quite another text of some words here", "f4", 80), (2, a, "f5", 81), (2, a, "f5", 81), (1, a, "f1", 77)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, copy_rank int")
    got = simhash.one_of_each_class(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[3]], key=str)
    clash = docs.withColumn("row", F.lit("r")).withColumn("_row", F.lit("q")).withColumn("a.b", F.lit(1)).withColumn("label", F.lit(2))
    assert simhash.one_of_each_class(clash).columns == clash.columns


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


# 3


def brute_repeats(rows, length):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(found):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect()), key=str)


def test_repeats_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = registry.queries()["op3_suffix_dedup"](spark, data)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows, 200)


@pytest.mark.parametrize("length", [3, 7, 20, 45])
def test_repeats_of_other_lengths(spark, length):
    dice = random.Random(length)
    pool = ["".join(dice.choice("ab é") for _ in range(dice.randrange(0, 120))) for _ in range(12)]
    rows = [(i, "".join(dice.choice(pool)[dice.randrange(30) :] for _ in range(3))) for i in range(60)] + [(None, "ab" * 40), (99, None), (5, "aaaa" * 30), (5, "aaaa" * 30)]
    docs = texts_of(spark, rows).repartition(3)
    assert digests(suffixes.repeated_strings(docs, length)) == brute_repeats(rows, length)


def test_repeats_awkward(spark):
    got = digests(suffixes.repeated_strings(texts_of(spark, AWKWARD)))
    assert got == brute_repeats(AWKWARD, 200)
    assert suffixes.repeated_strings(texts_of(spark, [])).collect() == []


@pytest.mark.parametrize("length", [64, 128, 1024])
def test_structured_texts_are_told_apart(spark, length):
    """Thue-Morse blocks and their complements, Fibonacci words, one letter, powers: strings that simple fingerprints confuse."""
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2 * length))
    fib = ["a", "ab"]
    while len(fib[-1]) < 2 * length:
        fib.append(fib[-1] + fib[-2])
    texts = [morse[:length], morse[length:], morse[:length].translate({97: 98, 98: 97}).replace("a", "c"), fib[-1][: 2 * length], "a" * (length + 3), "b" * length, "ab" * length, "\x00" * length, "\x00" * (length + 1)]
    rows = list(enumerate(texts)) + [(50, f"x{morse[:length]}y")]
    assert digests(suffixes.repeated_strings(texts_of(spark, rows), length)) == brute_repeats(rows, length)


def test_fingerprints_of_structured_windows():
    n = 1 << 16
    morse = np.array([i.bit_count() % 2 for i in range(n)], np.uint8) + 97
    for which in (0, 1):
        prints = suffixes.Prints(morse, which)
        for size in (128, 256, 1024, 4096):
            starts = np.arange(0, n - size, size // 4)
            got = prints.of(starts, starts + size)
            names = [morse[s : s + size].tobytes() for s in starts]
            assert len(set(got.tolist())) == len(set(names)) and all((a == b) == (x == y) for a, b, x, y in zip(got, got[1:], names, names[1:], strict=False))


def test_difference_covers():
    for most in (1, 7, 13, 40, 133, 200):
        v, cover = suffixes.difference_cover(most)
        assert v <= max(most, 1) and {(a - b) % v for a in cover for b in cover} == set(range(v))


# 2


def test_top_k_against_all_products(spark):
    dice = np.random.default_rng(3)
    rows = [(i, [int(x) for x in dice.integers(-300, 300, 12)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(9)] + [(500, [1, 2]), (501, []), (502, None), (None, [1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, lead=3, query_block=4, chunk=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    full = {i: v + [0] * (12 - len(v)) for i, v in rows if i is not None and v is not None}
    for q in (i for i in full if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(full[q], v, strict=True)), i) for i, v in full.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_integers(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "i int, e array<double>").select("i", topk.integers(F.col("e")).alias("v"))
    assert {r["i"]: r["v"] for r in df.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    large = spark.createDataFrame([(1, [1e6, -1e9, 3e16])], "i int, e array<double>").select(topk.integers(F.col("e")).alias("v"))
    assert large.first()["v"] == [256_000_000, -256_000_000_000, 3 * 10**16 * 256]
    with pytest.raises(Exception, match="leaves 64 bits"):
        spark.createDataFrame([([1e300],)], "e array<double>").select(topk.integers(F.col("e"))).collect()


def best_by_brute_force(rows, is_query, k=5):
    """{query: [(vec_id, score)]} where rows of one id are one candidate and one query."""
    out = {}
    for q in {i for i, _ in rows if is_query(i)}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(sum(a * b for a, b in zip(u, v, strict=True)) for j, u in rows if j == q) if i not in best else max(best[i], *(sum(a * b for a, b in zip(u, v, strict=True)) for j, u in rows if j == q))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found_best(df, is_query, **more):
    got = defaultdict(list)
    for r in topk.top_k(df, is_query, 5, **more).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(got)


@pytest.mark.parametrize("large", [10**6, 10**9, 2 * 10**9])
def test_top_k_of_large_components(spark, large):
    """Sums beyond 2^53, and products and sums that leave 64 bits only for pairs that are not asked for or stay within it."""
    dice = np.random.default_rng(8)
    rows = [(i, [int(x) for x in dice.integers(-large, large, 4)] if i % 3 else [int(x) for x in dice.integers(-5, 5, 4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = found_best(df, F.col("vec_id") % 50 == 0, lead=2, query_block=2, chunk=16)
    assert got == best_by_brute_force(rows, lambda i: i % 50 == 0)


def test_top_k_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40]), (2, [1])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()
    assert found_best(spark.createDataFrame([(0, [1 << 40]), (1, [-(1 << 40)]), *((i, [i]) for i in range(2, 9))], "vec_id long, v array<long>"), F.col("vec_id") == 0) == {0: [(i, i << 40) for i in range(8, 3, -1)]}


def test_top_k_of_repeated_ids(spark):
    dice = np.random.default_rng(9)
    rows = [(i % 40 if i % 7 else 0, [int(x) for x in dice.integers(-9, 9, 6)]) for i in range(160)] + [(7, [9] * 6)] * 5
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = found_best(df, F.col("vec_id") % 10 == 0, lead=2, query_block=3, chunk=8)
    assert got == best_by_brute_force(rows, lambda i: i % 10 == 0)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, v array<long>"), F.lit(True)).collect() == []


# 4

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    digits = lambda s: re.sub(r"\D", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    dice = random.Random(1)
    parts = ["a.b@c.d", "@", "x@y", ".com", "10.0.0.1", "256.1.1.1", ".5", "4111 1111 1111 1111", "-", " ", "+1 (988) 555-2485", "+", "(", "12345678", "é", "\n", "a@b-c.d.e@f.g", "4111-1111-1111-1112"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(12)))
        assert pii.detect(text) == brute_pii(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("bob [at] mail (dot) org", "email", "bob [at] mail (dot) org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one four one five five five five one two three four ok", "phone", "plus one four one five five five five one two three four"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
        ("at 192 dot 168 dot 0 dot 12 now", "ip", "192 dot 168 dot 0 dot 12"),
        ("10[.]0[.]0[.]999", "ip", None),
        ("jane { at } example.com", "email", "jane { at } example.com"),
        ("jane [ @ ] example.com", "email", "jane [ @ ] example.com"),
        ("jane <@> example.com", "email", "jane <@> example.com"),
        ("jane(\tat\t)example( . )com", "email", "jane(\tat\t)example( . )com"),
        ("call plus one 800 555 0199 soon", "phone", "plus one 800 555 0199"),
    ],
)
def test_disguises_map_back(text, kind, found):
    more = pii.disguised(text, pii.detect(text))
    assert [text[a:b] for a, b in more.get(kind, [])] == ([found] if found else [])


def test_plain_words_are_no_disguise():
    for text in ("meet me at the dot of noon. then go", "one two three and four", "he was at home dot", "sechs acht acht Uhr"):
        assert pii.disguised(text, pii.detect(text)) == {}, text


def hidden(kind, dice):
    """A made-up item of a kind, disguised."""
    names = [x.split()[0] for x in pii.NAMES]
    if kind == "email":
        user, host, end = dice.choice(["jane", "bob.k", "x_y", "info9"]), dice.choice(["example", "mail-box", "corp1"]), dice.choice(["com", "org", "de"])
        at, dot = dice.choice([" [at] ", "(at)", " { @ } ", "<at>", "[@]", " arroba ", " at "]), dice.choice([" dot ", "[.]", "(dot)", " punkt ", " [ . ] "])
        if dice.random() < 0.3:
            return f"{user}@{host}.{end}".replace("e", "е").replace("o", "о").replace("a", "а") if any(c in user + host + end for c in "eoa") else f"{user}[at]{host}.{end}"
        return f"{user}{at}{host}{dot}{end}"
    if kind == "ip":
        parts = [str(dice.randrange(256)) for _ in range(4)]
        return dice.choice(["[.]", "(.)", " dot ", "[dot]"]).join(parts) if dice.random() < 0.7 else ".".join(parts).translate({48 + i: 0xFF10 + i for i in range(10)})
    if kind == "phone":
        digits = [str(dice.randrange(10)) for _ in range(dice.randrange(8, 13))]
        return "plus " + " ".join(names[int(d)] for d in digits) if dice.random() < 0.5 else "+" + "".join(digits).translate({48 + i: 0xFF10 + i for i in range(10)})
    digits = "4" + "".join(str(dice.randrange(10)) for _ in range(14))
    digits += next(str(c) for c in range(10) if checksum(digits + str(c)))
    return " ".join(digits[i : i + 4] for i in range(0, 16, 4)).translate({48 + i: 0xFF10 + i for i in range(10)}) if dice.random() < 0.5 else "-".join(names[int(d)] for d in digits)


def test_recall_of_planted_disguises(spark):
    """Between words of the corpus: what was planted is found at its very place, and plain documents stay without further spans."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    dice = random.Random(12)
    hits, there = Counter(), Counter()
    for text in docs:
        words = text.split(" ")[:60]
        k = dice.randrange(len(words) + 1)
        kind = dice.choice(pii.KINDS)
        item = hidden(kind, dice)
        before = " ".join([*words[:k], "so: "])
        shown = f"{before}{item} ; {' '.join(words[k:])}"
        there[kind] += 1
        hits[kind] += (len(before), len(before) + len(item)) in pii.disguised(shown, pii.detect(shown)).get(kind, [])
    assert all(hits[k] >= 0.97 * there[k] for k in pii.KINDS), (hits, there)
    assert not any(pii.disguised(t, pii.detect(t)) for t in docs)


@pytest.mark.parametrize("part", ["dot" + " " * 999, "a dot ", "1 dot ", "[", "[ at ", "a at ", "a@", "a.", "x (at) y dot ", "one ", "plus - ", "+1(", "а dot "])
def test_time_grows_with_the_text(part):
    """Twice the text takes about twice the time, whatever it repeats; before, forty thousand blanks took a minute."""
    took = []
    for size in (200_000, 800_000):
        text = part * (size // len(part))
        start = time.process_time()
        pii.disguised(text, pii.detect(text))
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1 and took[1] < 20


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail me at john dot doe at example dot com", "john dot doe at example dot com"),
        ("a dot b [at] c dot com at once. x", "a dot b [at] c dot com"),
        ("one.two (at) site.org.", "one.two (at) site.org"),
        ("me at home. dot by dot com", None),
        ("10 dot 0 dot 0 dot 1 dot", "10 dot 0 dot 0 dot 1"),
        ("1 dot 2 dot 3 dot 4444", None),
    ],
)
def test_chains_of_disguised_signs(text, found):
    spans = pii.disguised(text, pii.detect(text))
    assert [text[s:e] for kind in spans for s, e in spans[kind]] == ([found] if found else [])


def test_pii_query(spark, data):
    """Counts, order and digest of the base spans against the contract."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.queries()["op4_pii"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_pii(docs[r["doc_id"]])
        shown = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and r["spans"] == shown


def test_pii_awkward(spark):
    got = pii.find_pii(texts_of(spark, [*AWKWARD, (9, "a@b.cd")])).collect()
    assert len(got) == len(AWKWARD) + 1
    assert [tuple(s) for r in got if r["doc_id"] == 9 for s in r["base"]] == [("email", 0, 6)]
    assert pii.find_pii(texts_of(spark, [])).collect() == []


# 7

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_rules():
    dice = random.Random(2)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", "=", ": ", " ", '"', "'", "abcdefghijkl", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "\n", "ſecret", "to", "ken", "x.y/z+w=="]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(14)))
        assert [(s, secrets.KINDS.index(k), e) for s, e, k in secrets.rules(text)] == brute_secrets(text), text


def path_score(scores, move, p):
    """Of tokens that stand between two that are outside."""
    whole = (0, *p, 0)
    return scores[range(len(p)), p].sum() + sum(move[a, b] for a, b in zip(whole, whole[1:], strict=False))


def test_best_tags_against_all_paths():
    """Decoding only what is not surely outside gives the best path over all tokens."""
    dice = np.random.default_rng(0)
    for scale in (1.0, 3.0, 8.0):
        for _ in range(40):
            n = 6
            scores, move = dice.normal(size=(n, 3)) * scale + np.array([scale / 2, 0, 0]), dice.normal(size=(3, 3)) + crf.blocked()
            want = max(np.ndindex(*[3] * n), key=lambda p: path_score(scores, move, p))
            ends = np.array([[0, crf.NEVER, crf.NEVER]])
            bounds = np.array([True, *[False] * n, True])
            got = crf.best_tags(np.concatenate([ends, scores, ends]), move, bounds)
            assert tuple(got[1:-1]) == want
            assert tuple(crf.viterbi(scores[None], move)[0]) == want == tuple(crf.viterbi(np.repeat(scores[None], 9, axis=0), move)[8])


def test_marginals_against_all_paths():
    dice = np.random.default_rng(1)
    score, move = dice.normal(size=(1, 4, 3)), dice.normal(size=(3, 3)) + crf.blocked()
    node, moves = crf.marginals(score, move, np.ones((1, 4), bool))
    total, want, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for p in np.ndindex(3, 3, 3, 3):
        w = math.exp(path_score(score[0], move, p))
        total += w
        want[range(4), p] += w
        for a, b in zip((0, *p), (*p, 0), strict=True):
            pairs[a, b] += w
    assert np.allclose(node[0], want / total) and np.allclose(moves, pairs / total)


def test_tokens_of_many_texts_are_those_of_each():
    texts = ["a password is Ab3dEf! (really)", "", "  \n", "x=1; y", "tail"]
    lexicon = crf.Lexicon()
    words = crf.Words(lexicon)
    crf.tokens_of(texts, words)
    together = crf.tokens_of(texts, words)
    apart = [crf.tokens_of([t], words) for t in texts]
    for i, f in enumerate(together.features):
        assert f[~together.bound()].tolist() == [x for one in apart for x in one.features[i][~one.bound()].tolist()]
    tags = np.where(together.bound(), 0, 1).astype(np.int8)
    assert [[t[a:b] for a, b in spans] for t, spans in zip(texts, crf.spans_of(tags, together, texts), strict=True)] == [crf.TOKEN.findall(t) for t in texts]


def passages_of(texts, dice):
    out = []
    for t in texts:
        w = (t or "").split(" ")
        k = dice.randrange(len(w))
        p = " ".join(w[max(0, k - 20) : k + 20])
        out.append((p, secrets._values(p)))
    return out


def test_tagger_on_kinds_it_has_not_seen(spark):
    """Recall by kind on other documents, for kinds that were planted in training and for those held out; and false alarms."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 6000").orderBy("doc_id").collect()]
    dice = random.Random(4)
    seen = tuple(k for k in planted.SECRETS if k not in planted.UNSEEN)
    model = crf.fit(*secrets.labelled(passages_of(docs[:2500], dice), seen))
    for kinds, least, mean in ((seen, 0.75, 0.95), (planted.UNSEEN, 0.6, 0.9)):
        shown = [planted.example(p, dice, kinds) for p, _ in passages_of(docs[2500:3700], dice)]
        hits, there, false = Counter(), Counter(), 0
        for (text, spans, names), found in zip(shown, secrets.predict(model, [t for t, _, _ in shown]), strict=True):
            for (a, b), k in zip(spans, names, strict=True):
                there[k] += 1
                hits[k] += any(min(e, b) - max(s, a) > 0.8 * (b - a) for s, e in found)
            known = spans + secrets._values(text)
            false += sum(all(e <= a or b <= s for a, b in known) for s, e in found)
        recall = {k: hits[k] / there[k] for k in there}
        assert min(recall.values()) >= least and sum(recall.values()) / len(recall) >= mean, recall
        assert false <= 12
    plain = [t for t in docs[4000:6000] if t and not secrets.rules(t)]
    assert sum(map(len, secrets.predict(model, plain))) <= 2
    said = "my password is SwordfishTrout ok", "use the token QwErTyUiOpAsDfGhJkLz now", "pwd hunter2 and no more", "curl -H 'Authorization: Bearer abcDEF123ghiJKL456'"
    assert [[t[a:b] for a, b in f] for t, f in zip(said, secrets.predict(model, list(said)), strict=True)] == [["SwordfishTrout"], ["QwErTyUiOpAsDfGhJkLz"], ["hunter2"], ["abcDEF123ghiJKL456"]]


def test_training_is_the_same_on_each_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = secrets.passages(docs, 50), secrets.passages(docs.repartition(5), 50)
    assert a == b and len(a) == 50 and secrets.passages(docs.limit(0)) == []
    one, two = crf.fit(*secrets.labelled(a), epochs=3), crf.fit(*secrets.labelled(b), epochs=3)
    assert all((x == y).all() for x, y in zip(one.emit, two.emit, strict=True)) and (one.move == two.move).all()


def test_secrets_query(spark, data):
    """Counts, order and digest of the base spans against the contract, and spans that the tagger adds on planted secrets only."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in registry.queries()["op7_secrets"](spark, data).collect():
        base = brute_secrets(docs[r["doc_id"]])
        shown = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(x[1] == i for x in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [x for x in every if not x.startswith("crf")] == shown
        assert [int(x.split(":")[1]) for x in every] == sorted(int(x.split(":")[1]) for x in every)


def test_secrets_awkward(spark):
    rows = [*AWKWARD, (9, "password=abcdefghijkl")]
    got = secrets.find_secrets(texts_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [tuple(s) for r in got if r["doc_id"] == 9 for s in r["base"]] == [("assign", 0, 21)]
    assert secrets.find_secrets(texts_of(spark, [])).collect() == []
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(texts_of(spark, rows), crf.fit([], [])).collect()}
    assert masked[9] == "[secret]" and masked[1] is None and masked[2] == ""


# 6


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), toxicity.categories_of(spark.read.parquet(f"{sf}/labels.parquet"))
    known = labels.filter("doc_id % 3 > 0")
    chain = toxicity.train(docs, known, toxicity.CATEGORIES, 2500)
    held = labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "y").select("doc_id", "y")
    rows = toxicity.score_toxicity(docs, chain, toxicity.CATEGORIES).join(held, "doc_id").collect()
    hits = sum(r["toxic"] and r["y"] for r in rows)
    assert hits / sum(r["y"] for r in rows) > 0.85 and hits / max(1, sum(r["toxic"] for r in rows)) > 0.9


def test_the_chain_against_brute_force(spark):
    """Probabilities of the query's operator are those of its weights, computed from the words alone; earlier categories feed later ones."""
    docs = texts_of(spark, [*AWKWARD, *((100 + i, f"you awful scum number{i} of the town" if i % 2 else f"you kind friend number{i} of the town") for i in range(60))])
    labels = spark.createDataFrame([(100 + i, i % 2 * (i % 3 > 0), i % 2) for i in range(60)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 == len(chain.index) + 2
    rows = docs.collect()
    for r, got in zip(rows, toxicity.score_toxicity(docs, chain, toxicity.CATEGORIES).collect(), strict=True):
        words = set(re.sub(rb"[^0-9A-Za-z\x80-\xff]", b" ", (r["text"] or "").lower().encode()).split())
        seen = words | {b"^" + w[:6] for w in words if len(w) > 6}
        before = []
        for w in chain.weights:
            z = sum(w[i] for f, i in chain.index.items() if f in seen) + sum(w[len(chain.index) + j] * x for j, x in enumerate(before)) + w[-1]
            p = min(max(1 / (1 + math.exp(-min(max(z, -30), 30))), 1e-6), 1 - 1e-6)
            before.append(math.log(p / (1 - p)))
            assert abs(got[1 + len(before) - 1] - p) < 1e-5
        assert got["toxic"] == (1 / (1 + math.exp(-before[-1])) >= chain.threshold)
    # conflicting and repeated labels: of a doc_id's rows the highest values count, whatever their order
    twice = labels.unionByName(labels.filter("doc_id < 110").select("doc_id", F.lit(0).alias("low_quality"), F.lit(0).alias("toxic")))
    again = toxicity.train(docs.unionByName(docs), twice.repartition(3), toxicity.CATEGORIES)
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, again.weights, strict=True)) and again.threshold == chain.threshold


def test_toxicity_awkward(spark):
    docs = texts_of(spark, [*AWKWARD, *((100 + i, f"you awful scum number{i}" if i % 2 else f"you kind friend number{i}") for i in range(40))])
    labels = spark.createDataFrame([(100 + i, 0, i % 2) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    got = toxicity.score_toxicity(docs, chain, toxicity.CATEGORIES).collect()
    assert len(got) == docs.count() and all(r["toxic"] == (r["doc_id"] % 2 == 1) for r in got if (r["doc_id"] or 0) >= 100)
    assert toxicity.reject_toxic(docs, chain).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0), toxicity.CATEGORIES) is None
    assert toxicity.score_toxicity(texts_of(spark, []), None, toxicity.CATEGORIES).collect() == []


# 1


def held(spark, docs, items, **more):
    docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(docs, items, **more).collect()}


ITEM = "A train leaves the station of Boston at 9 and runs 120 km before Alice boards it. How many km are left of the 300 when Alice sits down?"


def test_contamination(spark):
    other = ITEM.replace("Boston", "Chicago").replace("120", "75").replace("300", "410").replace("Alice", "Maria")
    mixed = ITEM.replace("before Alice", "before Maria")
    docs = [
        (1, f"Some words first. {ITEM} And some more."), (2, f"Before it. {other} After it."), (3, "Nothing of the kind is in this text, which speaks of other things."), (4, None), (5, ""),
        (6, ITEM.upper()), (7, mixed), (None, ITEM), (8, f"{ITEM} {ITEM}"), (9, LONG), (9, LONG), (10, " ".join(ITEM.split()[:12])),
    ]
    got = held(spark, docs, [(1, ITEM), (2, None), (3, ""), (4, "short one"), (None, ITEM)])
    assert {k for k in got} >= {(1, 1), (2, 1), (6, 1), (8, 1)} and not {k for k in got if k[0] in (3, 4, 5, 9, 10)}
    assert not got[1, 1]["reparameterised"] and got[2, 1]["reparameterised"] and got[1, 1]["coverage"] == 1.0
    # one name of two different ones in the same place is not a consistent change
    assert (7, 1) not in got or got[7, 1]["coverage"] < 1.0
    assert held(spark, [], [(1, ITEM)]) == {} and held(spark, docs, []) == {}
    # a word or two are in many texts by chance
    assert held(spark, docs, [(1, "Boston"), (2, "Alice sits down")]) == {}


def test_two_names_do_not_become_one(spark):
    item = "At the harbour Alice sold the old boat to Bruno and then Carla paid Alice for the sails of Bruno"
    one = item.replace("Alice", "Dora").replace("Bruno", "Dora")
    two = item.replace("Alice", "Dora").replace("Bruno", "Emil").replace("Carla", "Fanny")
    assert set(held(spark, [(1, one), (2, two)], [(1, item)])) == {(2, 1)}


@pytest.mark.parametrize(
    "item, changed",
    [
        ("Alice buys 12 apples at the market. Alice gives 5 apples to Ben. How many apples does Alice have?", "Maria buys 31 apples at the market. Maria gives 7 apples to Tom. How many apples does Maria have?"),
        ("Each of the pots holds 3.5 litres and the cook fills 8 pots", "Each of the pots holds 4 litres and the cook fills 12.75 pots"),
        ("The town bought 1,200 chairs and sold a third of them in spring", "The town bought 950 chairs and sold a third of them in spring"),
        ("A runner does 5km in the morning and 2x as much in the evening", "A runner does 7.5km in the morning and 3x as much in the evening"),
        ("A ticket at the fair costs €5 and a child pays half of it", "A ticket at the fair costs €7,50 and a child pays half of it"),
    ],
)
def test_changed_names_and_numbers(spark, item, changed):
    docs = [(1, f"First this. {changed} Then that."), (2, f"So {changed}"), (3, f"Here it is: {item}")]
    got = held(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1]["coverage"] == 1.0 and got[3, 1]["coverage"] == 1.0 and not got[3, 1]["reparameterised"]


def test_names_that_begin_sentences_must_agree(spark):
    item = "Alice buys 12 apples at the market. Alice gives 5 apples to Ben. How many apples does Alice have?"
    mixed = "Maria buys 31 apples at the market. Carol gives 7 apples to Tom. How many apples does Anna have?"
    # the first words differ, but the numbers still do for the rest
    article = "The shop in our town sells bread at 3 euros a loaf and it opens at 8. The baker rests on Sunday and bakes 40 loaves for the next day of work"
    other = article.replace("The shop", "A shop").replace(" 3 ", " 4 ").replace(" 8", " 9").replace("40", "55")
    got = held(spark, [(1, mixed), (2, f"Well: {other}")], [(1, item), (2, article)])
    assert set(got) == {(2, 2)}


def test_contamination_without_broadcast_or_bits(spark, monkeypatch):
    """Whatever the size of the table of bits and of the benchmark, the result is the same."""
    docs, items = [(1, f"x {ITEM} y"), (2, "nothing here at all to see")], [(1, ITEM), (2, "short one")]
    want = {k: tuple(v) for k, v in held(spark, docs, items).items()}
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 3)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 3)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 4)
    assert want and {k: tuple(v) for k, v in held(spark, docs, items).items()} == want


def test_bit_table_holds_each_hash(spark):
    dice = random.Random(6)
    hashes = [dice.getrandbits(64) - (1 << 63) for _ in range(500)] + [0, -1, 1 << 44, (1 << 63) - 1]
    table = decontaminate.bit_table(spark.createDataFrame([(h,) for h in hashes], "h long"), len(hashes))
    shift = 64 - (len(table) * 8).bit_length() + 1
    places = {(h % (1 << 64)) >> shift for h in hashes}
    assert {int(p) for p in np.flatnonzero(np.unpackbits(table, bitorder="little"))} == places


def brute_held(text, item, size=5):
    """The share of an item's windows that a text holds along alignments whose slots agree, from the words alone."""

    def tokens(t):
        out, fresh = [], True
        for w in decontaminate.tokens_of(t.encode()):
            if w == b"\x01":
                fresh = True
                continue
            plain = w.decode()
            kind = "#" if plain.replace("\x02", "").isdigit() else "n" if len(plain) > 1 and plain[0].isupper() and plain[1:].islower() else ""
            if plain.lower().encode() in decontaminate.UNITS and out and out[-1][1] == "#":
                kind = "u"
            out.append((plain.lower(), kind, fresh and kind == "n"))
            fresh = False
        return out

    def windows(words):
        """(place, form, what is shown, fillers), form being words, template, or template with names that begin sentences."""
        for i in range(len(words) - size + 1):
            part = words[i : i + size]
            yield i, 0, tuple(w for w, _, _ in part), ()
            for form in (1, 2):
                slot = [bool(k) and (form == 2 or not first) for _, k, first in part]
                if any(slot) and (form == 1 or any(first for _, _, first in part)):
                    yield i, form, tuple(k if s else w for (w, k, _), s in zip(part, slot, strict=True)), tuple(k + w for (w, k, _), s in zip(part, slot, strict=True) if s)

    ours = list(windows(tokens(item)))
    full = {i for i, f, _, x in ours if f == 1 and len(x) == size}
    usable = {i for i, *_ in ours} - full or {i for i, *_ in ours}
    if not usable:
        return 0.0
    by = defaultdict(list)
    for i, form, shown, fill in windows(tokens(text)):
        by[form > 0, shown].append((i, form, fill))
    lines = defaultdict(list)
    for i, form, shown, fill in ours:
        if i in usable and not (form == 2 and len(fill) == size):
            for at, other, theirs in by[form > 0, shown]:
                lines[at - i].append((i, max(form, other), set(zip(fill, theirs, strict=True))))

    def agrees(pairs):
        names = [p for p in pairs if p[0][0] != "#"]
        return len({a for a, _ in pairs}) == len(pairs) and len({b for _, b in names}) == len(names)

    found = set()
    for line in lines.values():
        narrow = agrees(set().union(*(p for _, f, p in line if f < 2)))
        wide = agrees(set().union(*(p for _, _, p in line)))
        found |= {i for i, f, p in line if f == 0 or (wide if f == 2 else narrow)}
    return len(found) / len(usable)


def renamed(item, dice):
    """The item with other numbers, and other names inside sentences and at their beginnings, each consistently."""
    new = {}

    def number(m):
        return new.setdefault(m[0], str(dice.randrange(1, 10 ** len(m[0])) + 10 ** len(m[0])))

    free = [a + b for a in ("Olga", "Pavel", "Quinn", "Rosa", "Sven", "Tilda") for b in ("na", "bert", "mir", "lina", "ko", "wen", "dor", "sam")]
    dice.shuffle(free)

    def name(m):
        return m[0] if m[0] in KEPT else new.setdefault(m[0], free[len(new)])

    return re.sub(r"\b[A-Z][a-z]+\b", name, re.sub(r"[0-9]+", number, item))


KEPT = frozenset("How In After The Each Which He Farmer".split())


def test_templates_against_brute_force(spark):
    """Pairs and coverage on documents, planted items and changed items, against a model that sees the words only."""
    sf = "/root/testdata/sf0.01"
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect() if r[0]]
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()}
    more = {900 + i: x for i, x in enumerate(WORD_PROBLEMS)}
    items |= more
    dice = random.Random(17)
    docs, planted_in = {}, {}
    for i, (k, x) in enumerate(items.items()):
        around = dice.choice(texts).split(" ")[:80]
        docs[i] = " ".join([*around[:40], ". " + renamed(x, dice) + " .", *around[40:]])
        planted_in[i] = k
    for i, t in enumerate(dice.sample(texts, 120), 1000):
        docs[i] = t[:20_000]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contamination(*(spark.createDataFrame(list(x.items()), f"{n}_id long, text string") for x, n in ((docs, "doc"), (items, "item")))).collect()}
    want = {}
    for d, t in docs.items():
        for k, x in items.items():
            share = brute_held(t, x)
            if share >= 0.8:
                want[d, k] = round(share, 6)
    assert got == want
    found = sum((d, k) in got for d, k in planted_in.items())
    assert found >= 0.9 * len(planted_in), (found, len(planted_in))
    assert all((d, k) in got for d, k in planted_in.items() if k in more)


WORD_PROBLEMS = [
    "Maria buys 12 apples at the market and gives 5 of them to her brother Tom. How many apples does Maria have left at the end of the day?",
    "Anna walks 3 km to the school. Ben walks 4 km. How far do Anna and Ben walk together in a week of 5 days?",
    "In a shop a pen costs 2 dollars and a book costs 15 dollars. How much does Peter pay for 3 pens and 2 books?",
    "A tank holds 250 litres of water and loses 8 litres an hour. After how many hours is less than 100 litres of water left in it?",
    "Lena is 7 years older than her cousin Oskar. In 4 years Lena will be twice as old as he is now. How old is Oskar?",
    "The bus to Berlin leaves at 9 and drives 80 km an hour. The train to Berlin leaves at 10 and drives 120 km an hour. Which one is first?",
    "Farmer Hans has 24 cows and 36 sheep on his land near Ulm. He sells a third of the cows. How many animals does Hans keep?",
    "Each of the 6 boxes holds 20 oranges. Clara takes 17 of them for a cake. How many oranges are left in the boxes?",
]


def test_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = ({r[0]: r[1] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op1_decontaminate"](spark, sf).collect()}
    assert want <= got and len(got) <= 1.2 * len(want)


# 5


def test_pages(spark, data):
    got = {r["page_id"]: r["text"] for r in registry.queries()["op5_html"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))
        assert got[r["page_id"]] == " ".join(stdlib_html.unescape(want).split())


def test_what_is_not_the_article(spark):
    page = """<html><head><title>T</title></head><body><header class=top>Site</header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
<div class="post post-{n}"><h1>T &amp; x</h1><p>One <b>two</b>three<br>four &lt;five&gt;</p><ul><li>six</li></ul><script>var a="</p>";</script><form>send</form><div class="advert">buy</div></div>
<aside>side</aside><section class="comments"><article class="comment"><p>I liked it very much indeed, a long reader comment that goes on and on and on</p></article></section><footer>end</footer></body></html>"""
    rows = [(i, f"https://h.example/{i}", page.replace("{n}", str(i)), "z") for i in range(5)]
    rows += [(5, None, None, "z"), (6, "", "", "z"), (7, "no url", "plain <b>text</b>", "z"), (7, "no url", "plain <b>text</b>", "z"), (8, "https://h.example/8", "<div>" * 3000 + "deep" + "</div>" * 3000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = [(r["page_id"], r["text"]) for r in html.extract(pages).collect()]
    assert sorted(got) == sorted([(i, "T & x One twothree four <five> six") for i in range(5)] + [(5, ""), (6, ""), (7, "plain text"), (7, "plain text"), (8, "deep")])
    assert html.extract(pages.limit(0)).collect() == []


ARTICLE = "<p>A first paragraph of the article, which is long enough to count.</p>"


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<p class="advert">Buy now</p>', ""),
        ('<p class="cookie-notice">We use cookies<p>Next', "Next"),
        ('<p>One <span class="ad">buy <span>this</span> now</span>two</p>', "One two"),
        ('<p>One <span class="ad">two</p>', "One two"),
        ('<ul><li class="menu-item">Home<li class="menu-item">More<li>Item</ul>', "Item"),
        ('<h2 class="section-header">Heading</h2>', "Heading"),
        ('<p class="text">x</p><div class="share-box"><a href=x>Share</a></div>', "x"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
        ("<object>shown</object>", "shown"),
        ("<svg><text>drawn</text></svg>after", "after"),
        ("<p>before</p><svg><p>rest", "before rest"),
        ("<button>press <p>rest", "press rest"),
        ("<select><option>one <p>rest", "one rest"),
        ("<select><option>one<option>two</select><p>rest", "rest"),
        ("<nav>links and the rest <p>of it", "links and the rest of it"),
        ("<script>if (a<b) {}</script>x<style>p{}</style>y<template><p>z</p></template>", "xy"),
        ("</section></aside></b>fine", "fine"),
        ("<form action=x>search <input></form>kept<form>mail <input></form>", "kept"),
    ],
)
def test_elements_in_an_article(inside, text):
    for before, after in (('<article class="post category-social">', "</article>"), ('<div class="entry tag-related-works">', "</div>"), ("<form><main>", "</main></form>")):
        page = html.parse(f"<body><header>Site</header>{before}{ARTICLE}{inside}{after}</body>")
        assert html.main_text(page, html.best_path(page)[0]) == " ".join(f"A first paragraph of the article, which is long enough to count. {text}".split()), before


SAYS = "This sentence says something about the thing at hand, and goes on. "


@pytest.mark.parametrize(
    "body, text",
    [
        # siblings of unlike size, and a wrapper around them
        (f'<div class="content"><div class="lead">{SAYS * 3}</div><div class="part">{SAYS * 20}</div></div>', SAYS * 23),
        (f'<div class="wrap"><div class="a">{SAYS * 2}</div><div class="b"><div class="c">{SAYS * 9}</div></div><div class="d">{SAYS}</div></div>', SAYS * 12),
        # an introduction right below the container
        (f'<div id="main">{SAYS}<div class="part">{SAYS * 20}</div></div>', SAYS * 21),
        # two articles
        (f"<main><article>{SAYS * 4}</article><article>{SAYS * 9}</article></main>", SAYS * 13),
        # ids that are made of headings, and classes of paragraphs
        (f'<article>{SAYS * 9}<section id="search-algorithms">Four</section></article>', SAYS * 9 + "Four"),
        (f'<article>{SAYS * 9}<h2 id="related-work">Related work</h2><p class="social-history">Of old.</p></article>', SAYS * 9 + "Related work Of old."),
        (f'<article>{SAYS * 9}<section id="related-links">No</section><div id="search-box">No</div><p class="share">No</p></article>', SAYS * 9),
        # what is hidden
        (f'<article>{SAYS * 9}<div hidden>No</div><div style="color:red; display : none">No</div><p>Yes</p><p hidden>No</p></article>', SAYS * 9 + "Yes"),
        # an article's header with its heading, and the page's
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{SAYS * 9}</article>", "Title " + SAYS * 9),
        (f"<article><header>By somebody</header>{SAYS * 9}</article>", SAYS * 9),
        # templates in templates, elements that are closed nowhere
        (f"<article>{SAYS * 9}<template><template>x</template>LEAK</template>Yes</article>", SAYS * 9 + "Yes"),
        (f"<article>{SAYS * 9}<noscript>Yes</article>", SAYS * 9 + "Yes"),
        (f"<article>{SAYS * 9}<iframe>Yes</article>", SAYS * 9 + "Yes"),
        (f"<article>{SAYS * 9}<script>no</article>", SAYS * 9),
        # menus beside the article, of links and without a name
        (f'<div><div>{"<a href=x>Some page of ours</a> " * 9}</div><div>{SAYS * 9}</div></div>', SAYS * 9),
        (f'<div><div class="related">{SAYS * 3}</div><div>{SAYS * 9}</div><div class="comments">{SAYS * 5}</div></div>', SAYS * 9),
    ],
)
def test_nothing_of_an_article_is_lost(body, text):
    page = html.parse(f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert html.main_text(page, None) == text.strip()
    assert html.main_text(page, html.best_path(page)[0]) == text.strip()


@pytest.mark.parametrize("part", ['<a "', "<a ", "<form>", "<form><div>", "<div id=x{}>", "<x{} class=ad>t", "<template>", "<header>", "<", "</", "<!--", "<a '>", "<p class=ad>", "<title>", "<ul><li>", "&amp;", "<table><tr><td>"])
def test_hostile_markup_takes_time_in_proportion(part):
    source = "<article>" + "".join(part.replace("{}", str(i)) for i in range(1_000_000 // len(part) // 2)) + "<p>end"
    start = time.process_time()
    html.main_text(html.parse(source), None)
    assert time.process_time() - start < 20


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    page = html.parse("<div class='a b'>" * 100_000 + "deep text" + "</div>" * 50_000 + "</section>" * 100_000 + "<span class=ad>" * 20_000)
    path, _ = html.best_path(page)
    assert html.main_text(page, path) == "deep text" and path.count("/") == 100_000
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_the_host_decides(spark):
    """A page whose comments are longer than its article is read by the path of its host."""
    page = "<div class=story><p>{a}</p></div><div class=below><p>{b}</p></div>"
    rows = [(i, "https://h.example/x", page.format(a="long article " * 20, b="note")) for i in range(4)] + [(9, "https://h.example/y", page.format(a="short article", b="other words " * 30))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short article"


# 8


def test_chats_read_back(spark):
    said = ["", "plain", "<|end|>\n", "<\\|x", "<|<\\\\|turn|>", "a<", "|b", "<|more|>\n", "\\", "é😀", None]
    dice = random.Random(4)
    rows = [(c, t, dice.choice(["user", "assistant", "system", None, "<|r|>"]), dice.choice(said), 0) for c in range(40) for t in range(dice.randrange(1, 9))]
    rows += [(77, t, ("user", "assistant")[t // 3 % 2], f"turn {t}", 0) for t in range(300)] + [(None, 1, "user", "x", 0), (78, None, "user", "y", 0), (78, None, "user", "y", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(turns).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in out} == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    for r in out:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        roles = [x for _, x, _ in sorted(want[r["conv_id"]])]
        assert r["formatted"].count("<|turn|>") == sum(a != b for a, b in zip(roles, [None, *roles], strict=False))
    assert chat.format_chats(turns.limit(0)).collect() == []


# 9


def test_counts_follow_the_distribution(spark):
    rows = spark.range(20_000).select(mixing.inverse_poisson(F.lit(2.5), mixing.uniform(F.lit("s"), F.col("id").cast("string"))).alias("k"))
    got = Counter(r["k"] for r in rows.collect())
    for k in range(7):
        want = math.exp(-2.5) * 2.5**k / math.factorial(k) * 20_000
        assert abs(got[k] - want) < 5 * math.sqrt(want)


def test_mixing(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small", 7) for i in range(6000)] + [(None, "no id", None, 7), (1, None, "big", 7), (2, "other", "rest", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("rest", None), (None, 0.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights).collect()
    n = Counter(r["source"] for r in got)
    assert abs(n["small"] / len(got) - 0.75) < 0.03 and abs(len(got) - 6000) < 400 and set(n) == {"big", "small"}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7), weights).collect()))
    assert max(Counter(r["doc_id"] for r in got if r["source"] == "small").values()) == max(r["copy"] for r in got if r["source"] == "small")
    clash = docs.select("doc_id", "text", "source", *(F.lit(77).alias(c) for c in ("rate", "_rate", "Times", "of_source", "n", "weight", "a.b", "SHUFFLE_KEY")))
    mixed = mixing.mix_sources(clash, weights)
    assert mixed.columns == [*clash.columns[:-1], "copy", "shuffle_key"]
    assert Counter(tuple(r)[:10] for r in mixed.collect()) == Counter((r["doc_id"], r["text"], r["source"], *[77] * 7) for r in got)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_large_means_are_drawn_in_parts(spark):
    docs = spark.createDataFrame([(i, "t", "a") for i in range(50)], "doc_id long, text string, source string")
    assert abs(mixing.mix_sources(docs, expected_rows=50_000).count() - 50_000) < 5 * math.sqrt(50_000)
