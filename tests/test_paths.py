"""Whole paths of retrieval and context against plain models, over whole tables."""

import hashlib
import re

from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import query
from tessera.operators import retrieve as R
from tessera.plans.common import chunks, questions
from tessera.plans.contexts import _hits
from tessera.plans.retrieval import _asked, _vectors


def words(text):
    return set(re.findall(r"\w+", text.lower()))


def tokens(text):
    return max(1, len(text) // 4) if text else 0


def context(rows, budget):
    """Rows (chunk_id, document_id, text, score) of one question: each chunk once, unlike those before, while tokens fit."""
    taken, used, blocks = [], 0, []
    for chunk, document, text, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        mine = words(text)
        if any(mine and w and len(mine & w) / len(mine | w) >= 0.85 for _, _, w in taken):
            continue
        taken.append((document, text, mine))
    for n, (document, text, _) in enumerate(taken, 1):
        used += tokens(text)
        if used > budget and n > 1:
            break
        blocks.append(f"[Source {n}] | {document}\n{text}")
    return len(blocks), "\n\n".join(blocks)


def test_context_text(spark, data):
    held = {}
    for r in _hits(spark, data).collect():
        held.setdefault(r["query_id"], []).append((r["chunk_id"], r["document_id"], r["text"], r["score"]))
    want = {q: context(rows, 3000) for q, rows in held.items()}
    got = {r["query_id"]: (r["n_sources"], r["n_chars"], r["digest"]) for r in registry.queries()["context_text"](spark, data).collect()}
    assert got == {q: (n, len(t), hashlib.md5(t.encode()).hexdigest()) for q, (n, t) in want.items()}


def test_search_pipeline(spark, data):
    rows, asked = chunks(spark, data), questions(spark, data).select("query_id", query.rewrite(F.col("query")).alias("query"))
    texts = {r["chunk_id"]: (r["document_id"], r["text"]) for r in rows.collect()}
    said = {r["query_id"]: r["query"] for r in asked.collect()}
    lists = {}
    for name, found in (("dense", R.dense(_vectors(spark, data), _asked(spark, data), 20)), ("bm25", R.bm25(rows, asked, 20))):
        for r in found.collect():
            lists.setdefault(r["query_id"], {"dense": {}, "bm25": {}})[name][r["chunk_id"]] = r["rank"]
    keyed = lambda text: [w for w in re.findall(r"\w+", text.lower()) if re.fullmatch("[a-z0-9]{2,}", w)]
    want = {}
    for q, both in lists.items():
        fused = {c: round(sum(0.5 / (60 + both[n].get(c, len(both[n]) + 1)) for n in both), 9) for c in {*both["dense"], *both["bm25"]}}
        first = sorted(fused, key=lambda c: (-fused[c], c))[:20]
        own = set(keyed(said[q]))
        score = {c: round(len(own & set(keyed(texts[c][1]))) / max(len(own), 1), 6) for c in first if c in texts}
        best = sorted(score, key=lambda c: (-score[c], c))[:10]
        n, text = context([(c, *texts[c], score[c]) for c in best], 3000)
        want[q] = (n, len(text))
    got = {r["query_id"]: (r["n_sources"], r["n_chars"]) for r in registry.queries()["search_pipeline"](spark, data).collect()}
    assert got == want
