"""What is kept over time: units that change as a whole, and a keyword index that grows, changes and is merged."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve as R
from tessera.operators import snapshots
from tessera.operators.keyword import KeywordIndex
from tessera.operators.snapshots import Pointer, Units, replace_documents, wrong_dimension
from tessera.streaming import live as L
from tessera.streaming.cache import ROCKS, cached, hit_rates


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_states_are_swapped_once(spark, tmp_path):
    one, two = Pointer(spark, str(tmp_path)), Pointer(spark, str(tmp_path))
    assert one.read() == (0, {})
    assert one.swap(1, {"a": 1}) and not two.swap(1, {"a": 2})
    assert two.read() == (1, {"a": 1})
    # a writer that came second does its change anew, on top of the other's
    assert two.commit(lambda s: s | {"b": 2}) == 2 and one.commit(lambda s: s | {"c": 3}) == 3
    assert one.read()[1] == {"a": 1, "b": 2, "c": 3} and one.read(1)[1] == {"a": 1}
    assert one.commit(lambda s: None) == 3
    with pytest.raises(KeyError):
        one.read(9)


def test_units_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Units(spark, str(tmp_path))
    table = lambda *r: spark.createDataFrame(list(r), "unit string, id int, v string")
    units = lambda *u: spark.createDataFrame([(x,) for x in u], "unit string")
    with pytest.raises(KeyError):
        store.read("tables")
    first = store.commit({"tables": table(("a", 1, "old"), ("b", 2, "old")), "images": table(("a", 7, "i"))}, units("a", "b"))
    seen = {}

    def between(change):
        # all files of the second commit are there, its state is not
        seen["tables"], seen["images"] = rows(store.read("tables"), "unit", "v"), rows(store.read("images"), "unit", "id")
        return Pointer.commit(store.pointer, change)

    monkeypatch.setattr(store.pointer, "commit", between)
    second = store.commit({"tables": table(("a", 3, "new"), ("a", 4, "new")), "images": table(("a", 8, "i"))}, units("a", "c"))
    monkeypatch.undo()
    assert seen == {"tables": [("a", "old"), ("b", "old")], "images": [("a", 7)]}
    assert rows(store.read("tables"), "unit", "id") == [("a", 3), ("a", 4), ("b", 2)] and rows(store.read("images"), "id") == [(8,)]
    # a reader that holds the first state keeps it
    assert rows(store.read("tables", first), "unit", "id") == [("a", 1), ("b", 2)]
    # a unit without rows is gone
    store.commit({"tables": table()}, units("b"))
    assert rows(store.read("tables"), "unit", "id") == [("a", 3), ("a", 4)]
    assert rows(store.read("tables", second), "unit", "id") == [("a", 3), ("a", 4), ("b", 2)]
    store.merge()
    assert rows(store.read("tables"), "unit", "id") == [("a", 3), ("a", 4)] and rows(store.read("images"), "id") == [(8,)]
    assert len(store.forget()) == 3
    assert rows(store.read("tables"), "unit", "id") == [("a", 3), ("a", 4)]


def test_nothing_is_written_if_a_row_is_wrong(spark, tmp_path):
    store = Units(spark, str(tmp_path))
    units = spark.createDataFrame([("a",)], "unit string")
    vectors = lambda *v: spark.createDataFrame([("a", x) for x in v], "unit string, vector array<double>")
    for bad in (vectors([1.0, 2.0], [1.0]), vectors([1.0, 2.0], None), vectors([1.0, 2.0]).withColumn("unit", F.lit("other"))):
        with pytest.raises(ValueError):
            store.commit({"vectors": bad}, units, wrong_dimension(2))
    assert not (tmp_path / "data").exists() and store.pointer.read() == (0, {})
    store.commit({"vectors": vectors([1.0, 2.0])}, units, wrong_dimension(2))
    assert store.read("vectors").count() == 1


def test_replaced_documents(spark, tmp_path):
    store = Units(spark, str(tmp_path))
    docs = lambda *r: spark.createDataFrame(list(r), "document_id long, text string")
    replace_documents(store, docs((1, "a"), (2, "b"), (3, None)))
    replace_documents(store, docs((1, "a"), (2, "b2"), (4, "d"), (4, "c")))
    replace_documents(store, docs())
    assert rows(store.read("documents"), "unit", "text") == [("1", "a"), ("2", "b2"), ("3", None), ("4", "d")]
    assert rows(store.read("versions"), "unit", "version") == [("1", 1), ("2", 1), ("2", 2), ("3", 1), ("4", 1)]
    assert rows(store.read("jobs"), "unit", "version", "status") == [("1", 1, "queued"), ("2", 2, "queued"), ("3", 1, "queued"), ("4", 1, "queued")]
    with pytest.raises(ValueError):
        replace_documents(store, docs((None, "x")))


def test_another_writer_comes_first(spark, tmp_path, monkeypatch):
    pointer = Pointer(spark, str(tmp_path))
    monkeypatch.setattr(pointer, "swap", lambda number, state: False)
    with pytest.raises(snapshots.Conflict):
        pointer.commit(lambda s: {}, tries=3)


WORDS = [f"w{i}" for i in range(40)]


def told(index, asked):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in index.search(asked, 5).collect())


def wanted(spark, texts, asked):
    chunks = spark.createDataFrame(sorted(texts.items()), "chunk_id long, text string")
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in R.bm25(chunks, asked, 5).collect()), tuple(R.corpus_stats(chunks).first())


def test_an_index_that_changes(spark, tmp_path):
    dice = random.Random(6)
    text = lambda: " ".join(dice.choices(WORDS, k=dice.randrange(0, 30)))
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w7 w7 unknown"), (3, ""), (4, None), (5, " ".join(WORDS))], "query_id long, query string")
    index, texts = KeywordIndex(spark, f"{tmp_path}/index", run=4), {}
    assert index.status().first()["n"] == 0 and told(index, asked) == [] and index.frequencies().count() == 0
    for batch in range(3):
        changes = [(i, None if dice.random() < 0.3 else text(), s) for i in dice.choices(range(60), k=40) for s in (batch,)]
        changes += [(100, "w1 first", batch), (None, "lost", batch)]
        # of several changes of a chunk the last counts
        last = {}
        for i, t, s in changes:
            last[i] = max([last[i], (s, t)], key=lambda x: (x[0], x[1] or "")) if i in last else (s, t)
        changes += [(101, "w2", -1), (101, f"w{batch}", batch)]
        last[101] = (batch, f"w{batch}")
        frame = spark.createDataFrame(changes, "chunk_id long, text string, seq int")
        # max_by takes the greatest struct, in which a null text is the least
        for i, (_, t) in last.items():
            if i is not None:
                texts.pop(i, None) if t is None else texts.__setitem__(i, t)
        assert index.apply(frame, batch)
        assert not index.apply(frame, batch)
        want, stats = wanted(spark, texts, asked)
        assert told(index, asked) == want and tuple(index.status().first()) == pytest.approx(stats)
        if batch in (1, 2):
            state = index.pointer.read()[0]
            assert index.merge(2) and len(index.pointer.read()[1]["segments"]) == len(index.pointer.read(state)[1]["segments"]) - 1
            assert told(index, asked) == want and tuple(index.status().first()) == pytest.approx(stats)
    chunks = spark.createDataFrame(sorted(texts.items()), "chunk_id long, text string")
    df = lambda x: rows(x, "term", "df")
    assert df(index.frequencies()) == df(R.document_frequency(R.postings(chunks)))
    while index.merge(2):
        pass
    assert told(index, asked) == want
    index.forget()
    assert told(index, asked) == want and len(list((tmp_path / "index" / "data").iterdir())) == len(index.pointer.read()[1]["segments"])
    index.build(chunks)
    assert told(index, asked) == want
    with pytest.raises(ValueError):
        index.build(chunks.unionByName(chunks.limit(1)))
    assert told(index, asked) == want
    index.clear()
    assert told(index, asked) == [] and index.status().first()["n"] == 0


def test_an_index_as_a_stream_goes_on_after_a_failure(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a1 b1", 0), (2, "a1", 0)], "chunk_id long, text string, seq int")
    changes.write.parquet(f"{tmp_path}/in")
    index = KeywordIndex(spark, f"{tmp_path}/index")
    broken = index.writer()

    def fails(batch, number):
        broken(batch, number)
        raise RuntimeError("after the swap")

    with pytest.raises(Exception, match="after the swap"):
        L.drained(L.stream_of(spark, f"{tmp_path}/in"), "append", fails, f"{tmp_path}/check")
    for _ in range(2):
        L.drained(L.stream_of(spark, f"{tmp_path}/in"), "append", index.writer(), f"{tmp_path}/check")
    assert tuple(index.status().first()) == (2, 3, 1.5) and rows(index.frequencies(), "term", "df") == [("a1", 2), ("b1", 1)]


def test_blocks_are_left_aside(spark, tmp_path):
    dice = random.Random(7)
    # common words everywhere, one rare word in some chunks of one length
    texts = [(i, " ".join(dice.choices(["aa", "bb", "cc", "dd"], k=10 + i % 7 * 20)) + (" gold gold" if i % 97 == 0 else "")) for i in range(4000)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "gold aa bb cc"), (2, "gold")], "query_id long, query string")
    index = KeywordIndex(spark, f"{tmp_path}/index", run=16)
    index.build(chunks)
    hits, report = index.look(asked)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, R.bm25(chunks, asked).select(*hits.columns).collect()))
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in report.collect()}
    assert read[1][1] < read[1][0] / 2


def test_a_cache_over_batches(spark, tmp_path):
    ts = lambda s: f"2024-01-01 {s // 3600:02}:{s % 3600 // 60:02}:{s % 60:02}"
    schema = "key string, request_id long, ts string"
    parts = [[("a", 1, ts(0)), ("a", 2, ts(50)), ("b", 3, ts(10)), (None, 9, ts(10))], [("a", 4, ts(140)), ("b", 5, ts(200)), ("c", 6, ts(900))], [("a", 7, ts(5000)), ("c", 8, ts(999))]]
    for r in parts:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.to_timestamp("ts"))
    got = L.result(cached(stream, 100, "10 seconds"), "append", settings=ROCKS)
    assert rows(got, "request_id", "key", "hit", "idle") == sorted(
        [(1, "a", False, None), (2, "a", True, 50.0), (3, "b", False, None), (4, "a", True, 90.0), (5, "b", False, None), (6, "c", False, None), (8, "c", True, 99.0), (7, "a", False, None)], key=str
    )
    assert rows(hit_rates(got), "key", "n", "hits", "rate") == [("a", 4, 2, 0.5), ("b", 2, 0, 0.0), ("c", 2, 1, 0.5)]
