"""Queries that SQL cannot express, over whole tables, against plain models."""

import re

from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import clean, tokens
from tessera.operators.store import TRANSITIONS
from tessera.plans.relational import JOB_STATUS


def rows(spark, data, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{data}/{table}.parquet").select(*columns).collect()]


def test_job_states(spark, data):
    want = {}
    events = sorted(rows(spark, data, "events", "user_id", "ts", "event_id", "event_type"), key=lambda r: (r[1], r[2]))
    for user, _, _, kind in events:
        status, refused = want.get(user, ("", 0))
        new = JOB_STATUS.get(kind)
        ok = (not status and new == "queued") or new in TRANSITIONS.get(status, ())
        want[user] = (new, refused) if ok else (status, refused + 1)
    got = {r["job_id"]: (r["status"], r["n_refused"]) for r in registry.queries()["stream_job_states"](spark, data).collect()}
    assert got == want


def test_sentences(spark, data):
    split = re.compile(tokens.SENTENCE_END, re.ASCII)
    want = {i: sum(bool(s.strip(" \t\n\x0b\f\r")) for s in split.split(t)) for i, t in rows(spark, data, "documents", "doc_id", "text") if t is not None}
    got = {r["doc_id"]: r["n_sentences"] for r in registry.queries()["sentences"](spark, data).collect() if r["n_sentences"] >= 0}
    assert got == want


def test_html_sections(spark, data):
    names = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\x20"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))

    def plain(x):
        x = re.sub(r"(?s)<[^>]*>", "\n", x)
        for a, b in names:
            x = x.replace(a, b)
        return "\n".join(y for y in (line.strip(" ") for line in x.split("\n")) if y)

    want = {}
    for page, html in rows(spark, data, "pages", "page_id", "html"):
        bare = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "", html)
        for i, part in enumerate(re.split(r"(?i)<h[1-6][^>]*>", bare)):
            m = re.match(r"(?is)(.*?)</h[1-6]>", part)
            title = plain(m[1] if m else "") if i else None
            want[page, i] = (title, len(plain(part[m.end() :] if m and i else part)))
    got = {(r["page_id"], r["page_number"]): (r["title"], r["n_chars"]) for r in registry.queries()["html_sections"](spark, data).collect()}
    assert got == want


def test_cleaning_is_its_stages_one_after_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    for _, stage in clean.STAGES:
        step = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", stage(F.col("text")))
        texts = dict(map(tuple, step.collect()))
    got = {r["doc_id"]: r["text"] for r in clean.clean_column(docs, "text").collect()}
    assert got == texts and any(t != s for t, s in zip(texts.values(), dict(map(tuple, docs.collect())).values(), strict=True))
