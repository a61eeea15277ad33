"""Reports on answers, jobs and their stages, the keyword index, units of work, retries, languages."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.operators import embed as M
from tessera.operators import evaluate as E
from tessera.operators import retrieve as R
from tessera.operators import store as S

SOURCES = {
    1: {10: "The river Rhine is 1230 kilometres long and flows through Basel.", 11: "Cologne lies on the Rhine and has a famous cathedral.", 12: "Bananas are yellow fruit."},
    2: {20: "Photosynthesis turns light into chemical energy in plants."},
}
ANSWERS = {
    1: "The Rhine is 1230 kilometres long and flows through Basel [1]. The cathedral of Cologne stands near the Rhine [2-3]. Quantum computers were invented by Napoleon in Paris [7].",
    2: "I don't have enough information to answer it. The unrelated claim about Jupiter and its moons remains unsupported here.",
    3: "Nothing was given as a source for this answer, which is long enough to count as one of more than eighty characters.",
    4: "Yes.",
}


def model(answer, sources):
    """The report of one answer from its text."""

    def words(t):
        found = [re.sub(r"^[-'_]+|[-']+$", "", w) for w in re.findall(r"[\w'-]+", t.lower())]
        return [w for w in found if re.fullmatch(r"[a-z0-9][a-z0-9'-]*", w) and len(w) >= 3 and w not in tokens.GROUNDING_STOPWORDS]

    cited = {int(x) for x in re.findall(r"\[(\d+)\]", answer)} | {n for a, b in re.findall(r"\[(\d+)-(\d+)\]", answer) for n in range(int(a), int(b) + 1)}
    bare = re.sub(r"\[\d+(?:[-,]\d+)*\]", "", answer)
    sentences = [s.strip() for s in re.split(r'(?<=[.!?])\s+(?=[A-Z"])', bare)]
    texts = [*sources.values(), answer]
    df = Counter(w for t in texts for w in set(words(t)))
    idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}

    def vector(t):
        w = words(t)
        return {k: n / len(w) * idf.get(k, 1.0) for k, n in Counter(w).items()}

    def cosine(a, b):
        dot = sum(x * b.get(k, 0) for k, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0

    scores = {s: max((cosine(vector(s), vector(t)) for t in sources.values()), default=0.0) for s in sentences if len(s) >= 30 and words(s)}
    return {
        "citation_count": sum(1 <= n <= len(sources) for n in cited),
        "invalid_citations": sorted(n for n in cited if not 1 <= n <= len(sources)),
        "confidence": round(sum(scores.values()) / len(scores), 3) if scores and sources else 1.0,
        "n_sentences": len(scores),
        "low": [s for s, x in scores.items() if x < 0.12] if sources else [],
    }


def test_grounding_report(spark):
    answers = spark.createDataFrame(list(ANSWERS.items()), "answer_id long, answer string")
    sources = spark.createDataFrame([(a, c, t) for a, of in SOURCES.items() for c, t in of.items()], "answer_id long, chunk_id long, text string")
    got = {r["answer_id"]: r for r in E.grounding_report(answers, sources).collect()}
    assert set(got) == set(ANSWERS)
    for i, answer in ANSWERS.items():
        want = model(answer, SOURCES.get(i, {}))
        for c in ("citation_count", "invalid_citations", "n_sentences"):
            assert got[i][c] == want[c], (i, c)
        assert got[i]["confidence"] == pytest.approx(want["confidence"], abs=1e-3)
        assert got[i]["n_unsupported"] == (0 if got[i]["admits_gap"] else len(want["low"]))
    assert got[1]["issues"][0] == "no source [7]" and any("Napoleon" in x for x in got[1]["issues"]) and got[1]["citation_coverage"] == 0.6667 and not got[1]["valid"]
    assert got[2]["admits_gap"] and got[2]["issues"] == ["no citations"] and got[3]["valid"] and "too short" in got[4]["issues"]


def test_evaluation_report(spark):
    per = spark.createDataFrame([(1, 2, 0.5), (2, 1, 1.0)], "query_id long, n_relevant long, recall_1 double")
    said = spark.createDataFrame([(1, "It is so [1]. It is not at all.", 10.0, 7), (2, "None of it is cited here.", 15.5, 8)], "query_id long, answer string, latency_ms double, tokens int")
    r = E.evaluation_report(per, said).first()
    assert (r["n_queries"], r["recall_1"], r["n_answers"], r["latency_ms"], r["tokens"], r["citation_coverage"]) == (2, 0.75, 2, 12.75, 7.5, 0.25)


def test_job_lifecycle(spark):
    jobs = spark.createDataFrame([(1, "queued", "c"), (2, "processing", "c"), (3, "completed", "c"), (4, "retrying", "c")], "job_id long, status string, checkpoint string")
    some = spark.createDataFrame([(1,), (3,), (4,), (9,)], "job_id long")
    assert {r["job_id"]: (r["status"], r["refused"]) for r in S.cancel(jobs, some).collect()} == {1: ("cancelled", False), 2: ("processing", False), 3: ("completed", True), 4: ("cancelled", False)}
    assert {r["job_id"]: (r["status"], r["checkpoint"], r["refused"]) for r in S.reset_for_retry(jobs, some).collect()} == {1: ("queued", "c", True), 2: ("processing", "c", False), 3: ("completed", "c", True), 4: ("queued", None, False)}
    events = spark.createDataFrame([(1, "extracting", 1, 1), (1, "cleaning", 2, 2), (1, "odd", 3, 3), (2, "completed", 1, 4)], "job_id long, stage string, ts long, event_id long")
    assert {tuple(r) for r in S.stage_progress(events).collect()} == {(1, "cleaning", 40), (2, "completed", 100)}


def test_records_and_reindexing(spark):
    chunks = spark.createDataFrame([(1, "d1", "a"), (2, "d1", None), (3, "d2", "c")], "chunk_id long, document_id string, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, None)], "chunk_id long, vector array<double>")
    rows = {r["chunk_id"]: r for r in S.vector_records(chunks, vectors, "m").collect()}
    assert set(rows) == {1, 2} and rows[2]["text"] == "" and rows[1]["language"] == "unknown" and rows[1]["version"] == 1 and rows[1]["page_number"] is None and rows[1]["embedding_model"] == "m"
    new = spark.createDataFrame([(4, "d1", "new")], "chunk_id long, document_id string, text string")
    assert sorted(r["chunk_id"] for r in S.reindexed(chunks, new).collect()) == [3, 4]
    assert S.get_vector(vectors, 2).first()["vector"] == [2.0] and S.get_vector(vectors, 9).count() == 0
    sums = lambda df: df.withColumn("checksum", F.md5("text"))
    assert [r["chunk_id"] for r in S.changed(sums(new.unionByName(chunks.limit(1))), sums(chunks)).collect()] == [4]


def test_retries():
    waits, calls = [], []

    def failing(n, error):
        def provider(texts):
            calls.append(1)
            if len(calls) <= n:
                raise error
            return [[1.0]] * len(texts)

        return provider

    assert M.with_retries(failing(2, M.Transient("down")), 3, waits.append)(["x"]) == [[1.0]]
    assert 1 <= waits[0] <= 1.2 and 2 <= waits[1] <= 2.4
    calls.clear(), waits.clear()
    with pytest.raises(M.Transient):
        M.with_retries(failing(99, M.Transient("busy", limited=True)), 6, waits.append)(["x"])
    assert len(calls) == 7 and waits[-1] == 60.0 and 2 <= waits[0] <= 2.4
    calls.clear()
    with pytest.raises(ValueError):
        M.with_retries(failing(1, ValueError("bad")), 3, waits.append)(["x"])
    assert len(calls) == 1


def test_input_checks(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, " "), (3, None), (4, "x" * 50), (5, "a"), (5, "b")], "chunk_id long, text string")
    assert sorted(tuple(r) for r in M.batch_errors(rows, 10).collect()) == [(2, "blank"), (3, "blank"), (4, "too long"), (5, "repeated id")]


def test_languages(spark):
    rows = spark.createDataFrame([("de",), ("zh-cn",), ("xx",)], "c string").select(tokens.language_name(F.col("c")), tokens.is_supported(F.col("c")))
    assert [tuple(r) for r in rows.collect()] == [("German", True), ("Chinese (Simplified)", True), ("xx", False)] and len(tokens.LANGUAGES) == 56
