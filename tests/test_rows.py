"""Rows that must not be lost: null texts and conditions, vectors without direction, repeated keys, batches, line ends in quotes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import checkpoints
from tessera.functions import clean as C
from tessera.functions import query as Q
from tessera.operators import embed as M
from tessera.operators import retrieve as R
from tessera.operators import store as S
from tessera.sources import extract as X
from tessera.operators.keyword import KeywordIndex
from tessera.streaming import live as L

NAN, INF = float("nan"), float("inf")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_vectors_without_direction_take_no_place(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_NUMBERS", most)
    dice = np.random.default_rng(2)
    good = [(i, [float(x) for x in dice.normal(size=4)]) for i in range(20)]
    bad = [(100 + i, [0.0] * 4) for i in range(12)] + [(120, None), (121, [NAN, 1.0, 0.0, 0.0]), (122, [INF, 1.0, 0.0, 0.0]), (123, [None, 1.0, 0.0, 0.0]), (124, [])]
    tiny = [(30, [1e-200, 0.0, 0.0, 0.0]), (31, [1e200, 1e200, 0.0, 0.0])]
    vectors = spark.createDataFrame(good + bad + tiny, "chunk_id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, good[0][1]), (2, [0.0] * 4), (3, None), (4, [1e-300, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = R.dense(vectors, asked, 3).select("query_id", "rank", "chunk_id", "score").orderBy("query_id", "rank").collect()

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    want = []
    for q, v in ((1, good[0][1]), (4, [1.0, 0.0, 0.0, 0.0])):
        scores = sorted(((-round(float(unit(v) @ unit(w)), 6), i) for i, w in good + tiny))[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert list(map(tuple, got)) == want


def test_small_measures_bytes(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().toString()
    rows = spark.range(10).withColumn("v", F.lit("x" * 1000))
    assert "ResolvedHint (strategy=broadcast)" in plan(R.small(rows)) and "broadcast" not in plan(R.small(rows, 5))
    monkeypatch.setattr(R, "MOST_BYTES", 5_000)
    assert "broadcast" not in plan(R.small(rows))


def test_filters_and_what_lacks_the_key(spark):
    rows = spark.createDataFrame([(1, "en", (2024,)), (2, None, (2020,)), (3, "fr", None)], "id int, lang string, metadata struct<year:int>")
    ids = lambda c: [r["id"] for r in rows.filter(c).orderBy("id").collect()]
    assert ids(R.predicate({"lang": "en"}, rows.columns)) == [1] and ids(R.predicate({"lang": "en"}, rows.columns, absent=True)) == [1, 2]
    assert ids(R.predicate({"metadata.year": {"gte": 2021}}, rows.columns)) == [1] and ids(R.predicate({"metadata.year": {"gte": 2021}}, rows.columns, absent=True)) == [1, 3]


def test_bm25_against_a_plain_model(spark):
    texts = ["red apple pie", "green apple", "", None, "pie pie pie chart", "nothing of it", "red"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "apple pie"), (2, "red red"), (3, "??"), (4, "absent")], "query_id long, query string")
    words = [(t or "").split() for t in texts]
    avg = sum(map(len, words)) / len(words)
    want = []
    for q, t in ((1, "apple pie"), (2, "red red")):
        scores = {}
        for w in set(t.split()):
            df = sum(w in x for x in words)
            for i, x in enumerate(words):
                if w in x:
                    tf = x.count(w)
                    scores[i] = scores.get(i, 0) + np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / avg))
        want += [(q, i, round(float(s), 6)) for i, s in scores.items()]
    assert rows_of(R.bm25(chunks, asked).select("query_id", "chunk_id", "score")) == sorted(want, key=str)


def test_chunks_without_text_have_a_row(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, " ")], "chunk_id long, text string")
    cache = spark.createDataFrame([], "checksum string, model string, dimension int, last_access timestamp, vector array<double>")
    got = {r["chunk_id"]: r["error"] for r in M.index_chunks(chunks, cache, M.hashing_provider(8), "hash", 8, F.current_timestamp()).collect()}
    assert got == {1: None, 2: "blank", 3: None, 4: "blank"}


def test_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "chunk_id int, text string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (2, "z", 1), (3, "a", 1), (4, "e", 1), (5, "e", 1)], "chunk_id int, text string, version int")
    assert rows_of(S.upsert(old, new, by=["version"])) == [(1, "a", 1), (2, "d", 3), (3, "a", 1), (4, "e", 1), (5, "e", 1)]
    for parts in (1, 4):
        assert [r["chunk_id"] for r in S.reject_duplicates(new.repartition(parts), old).orderBy("chunk_id").collect()] == [2, 2, 2, 4]


def test_cache_invalidation(spark):
    cache = spark.createDataFrame([("x", "m", 8), ("y", "m", 8), ("x", "n", 8)], "checksum string, model string, dimension int")
    some = spark.createDataFrame([("x",)], "checksum string")
    assert S.cache_invalidate(cache).count() == 0 and rows_of(S.cache_invalidate(cache, "m")) == [("x", "n", 8)]
    assert rows_of(S.cache_invalidate(cache, "m", some)) == [("x", "n", 8), ("y", "m", 8)] and rows_of(S.cache_invalidate(cache, checksums=some)) == [("y", "m", 8)]


def test_csv_reads_what_it_writes(spark):
    rows = [["a,b", 'say "hi"', "two\nlines", "\r\nx"], ["", '"', ",", "plain"], ["é", "\n", '""', " "]]
    df = spark.createDataFrame([([["h1", "h2", "h3", "h4"], *rows],)], "rows array<array<string>>").select(X.csv_table(X.rows_to_csv(F.col("rows"))).alias("t"))
    got = df.first()["t"]
    assert got["header"] == ["h1", "h2", "h3", "h4"] and got["rows"] == rows and got["row_count"] == 4


def test_dead_letters_keep_each_row_once(spark, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    write = L.with_dead_letters(good, bad, "kind = 'error'")
    batch = spark.createDataFrame([(1, "error", 3), (2, None, 3), (3, "ok", 3), (4, "error", 1), (5, "error", None)], "id int, kind string, retry_count int")
    for number in (0, 1, 1):
        write(batch, number)
    ids = lambda path: sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert ids(bad) == [1, 1] and ids(good) == [2, 2, 3, 3, 4, 4, 5, 5]
    assert rows_of(L.requeued(spark.read.parquet(bad)))[0] == (1, "error", 0)


def batches(spark, tmp_path, parts, schema):
    """A stream that reads one file a batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_job_states_over_batches(spark, tmp_path):
    ts = lambda minute: f"2024-01-01 00:{minute:02}:00"
    parts = [[(1, "queued", ts(0), 1), (2, "queued", ts(0), 2)], [(1, "processing", ts(1), 3), (2, "failed", ts(1), 4)], [(1, "completed", ts(2), 5)]]
    stream = batches(spark, tmp_path, parts, "job_id long, status string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    assert rows_of(L.result(L.job_states(stream), "update", ["job_id"])) == [(1, "completed", 0), (2, "queued", 1)]


def test_late_events_are_left_out_and_windows_dropped(spark, tmp_path):
    day = lambda d, h: f"2024-01-{d:02} {h:02}:10:00"
    parts = [[(1, day(1, 0)), (1, day(1, 0))], [(1, day(5, 0))], [(1, day(5, 1))], [(1, day(5, 1)), (1, day(1, 0))]]
    stream = batches(spark, tmp_path, parts, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = L.result(L.counts(stream, "1 hour"), "update", ["user_id", "w"]).select(F.date_format("w.start", "dd HH"), "n")
    assert rows_of(got) == [("01 00", 2), ("05 00", 1), ("05 01", 2)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "chunk_id long, text string, seq int"
    index = KeywordIndex(spark, f"{tmp_path}/index")
    for i in range(3):
        stream = batches(spark, tmp_path, [[(i, "one two", 0)]], schema)
        L.drained(stream, "append", index.writer(), f"{tmp_path}/check")
    assert tuple(index.status().first()) == (3, 6, 2.0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        checkpoints.shared_folder(Session())


def test_expansion_against_a_plain_model(spark):
    def model(q):
        lower, words, out = q.lower(), q.lower().split(), []
        said = [(p, True) for p in Q.SYNONYMS if p in lower]
        queue = [m for w in words for m in [*said, *([(w, False)] if w in Q.SYNONYMS else [])]]
        for phrase, anywhere in queue[:5]:
            out += [s for s in Q.SYNONYMS[phrase] if s not in (lower if anywhere else words) and s not in out][:3]
        return f"{q} ({' '.join(out)})" if out else q

    asked = ["revenue report", "training data for AI", "", "no match here", "Table of risk and data  analysis", "ai", "income earnings sales revenue", "database network security api cloud"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r[0] for r in df.select(Q.expand(F.col("q"))).collect()] == [model(q) for q in asked]
    assert spark.range(1).select(Q.expand(F.lit(None).cast("string")).alias("v")).first()["v"] is None


def test_lines_are_trimmed_whatever_their_place(spark):
    """The place of a line is not taken for the characters to trim."""
    html = "<p>0 zero 0</p><p> 1 one 1 </p><p>10 two 2</p><h1>1 Head 0</h1>x"
    got = spark.range(1).select(X.html_sections(F.lit(html)).alias("s")).first()["s"]
    assert got[0]["text"] == "0 zero 0\n1 one 1\n10 two 2" and got[1]["title"] == "1 Head 0"
    lines = [f"line {i}" for i in range(9)] + ["0 foot 9", " 0 foot 9", "0 foot 9 ", "0 foot 9"]
    assert spark.range(1).select(C.headers_and_footers(F.lit("\n".join(lines)))).first()[0] == "\n".join(lines[:9])
