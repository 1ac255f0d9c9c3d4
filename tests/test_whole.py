"""Queries over whole tables and whole texts, against brute force over rows that lie beyond any fixed id or prefix."""

import re

import pytest

from evidence_engine.operators import evaluate
from evidence_engine.plans import registry, views

WORDS = {"", "nan", "None", "NULL", "null"}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, f"text number {i} " + "word " * (30 + i) + f"fin{i}", ("en", "ko", "de", None)[i % 4], "web", 10) for i in range(20)]
    rows += [(20, None, "ko", "web", 0), (21, "ÀÉ Große 한국어 ㄱㄱ ÄB9 日本 a b", "de", "web", 0), (22, " " * 60 + "late start", None, "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{d}/documents.parquet")
    talks = [(i, t, ("user", "assistant")[t % 2], f"said {i} in turn {t}") for i in range(60) for t in range(4)]
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(0, "fin19 text"), (1, "fin5 number"), (2, "late start")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in rows}


def cited(spark, d, texts):
    ids = {f"D{k}": v for k, v in texts.items()}
    for r in views.predictions(spark, d).collect():
        asked = [x.strip() for x in r.cited_doc_ids.split("|") if x.strip()][:2]
        yield r, [(x, ids[x]) for x in asked if x in ids]


def test_context_docs(spark, docs):
    want = sorted((r.source_row_index, len(f), ",".join(x for x, _ in f)) for r, f in cited(spark, *docs))
    assert any("D19" in w[2] for w in want)
    assert sorted(map(tuple, registry.QUERIES["context_docs"](spark, docs[0]).collect())) == want


def test_contextual_input(spark, docs):
    def line(x, t):
        t = (t or "").strip()
        t = "" if t in WORDS else t
        return f"d={x};s=" + (t if len(t) <= 12 else t[:11].rstrip() + "…")

    want = sorted((r.source_row_index, "\n".join([f"q={r.query_type};m={r.match_status};b=x"] + [line(x, t) for x, t in f])) for r, f in cited(spark, *docs))
    assert sorted(map(tuple, registry.QUERIES["contextual_input"](spark, docs[0]).collect())) == want


def test_context_block(spark, docs):
    d, texts = docs
    got = {r.qid: r.context for r in registry.QUERIES["context_block"](spark, d).collect()}
    ranked = registry.QUERIES["retrieve_topk"](spark, d).orderBy("rank").collect()
    want = {q: "\n".join(f"[{r.doc}] {texts[r.doc] or ''}" for r in ranked if r.qid == q) for q in {r.qid for r in ranked}}
    assert got == want and got[0].startswith(f"[19] {texts[19]}")


def test_sanitize_outputs(spark, tmp_path):
    n = 1000
    names = {k: f"part {k % 200 if k <= 600 else k}" for k in range(1, n + 1)}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    question = {k: f"{v}{k % 40}" for k, v in names.items()}
    unique = {q: k for k, q in question.items() if list(question.values()).count(q) == 1}
    want = {}
    for k in sorted(names):
        i = unique.get(question[k]) if k % 3 == 0 else -k if k % 7 == 1 else k - 1 if k % 5 == 2 else k
        if i in names:
            want[i] = k
    got = [tuple(r) for r in registry.QUERIES["sanitize_outputs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.items()) and max(want) > 400


def test_normalize_text(spark, docs):
    d, texts = docs

    def plain(t):
        return None if t is None else " ".join(re.sub(r"[^0-9a-z가-힣\s]", " ", t.lower()).split())

    got = {r.doc_id: r.normalized for r in registry.QUERIES["normalize_text"](spark, d).collect()}
    assert got == {k: plain(t) for k, t in texts.items()} and got[21] == "gro e 한국어 b9 a b"


def test_edge_questions_reach_their_quotas(spark, sf):
    got = {r.type: r["count"] for r in registry.QUERIES["edge_questions"](spark, sf).groupBy("type").count().collect()}
    assert got == {"condition": 250, "comparison": 250, "multi_condition": 250, "region": 900, "vague": 175, "colloquial": 175}


def test_failure_buckets(spark, sf):
    flags = evaluate.failure_flags(views.predictions(spark, sf)).collect()
    want = {"legacy_schema": sum(r.is_legacy_schema for r in flags)}
    for f in ("unsafe_recommendation", "router_mismatch", "match_status_mismatch", "disclosure_miss", "area_band_unknown_candidate"):
        want |= {f: sum(bool(r[f]) for r in flags), f"{f}_current_schema": sum(bool(r[f]) and not r.is_legacy_schema for r in flags)}
    assert {r.bucket: r.rows for r in registry.QUERIES["failure_buckets"](spark, sf).collect()} == want and len(want) == 11
