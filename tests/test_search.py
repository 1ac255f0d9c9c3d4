"""Dictionary automata and the impact-ordered index against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import dictionary, impact, retrieve


def words(t):
    return set(re.sub(r"[^0-9a-z가-힣\s]", " ", (t or "").lower()).split())


@pytest.mark.parametrize("shards,splits", [(1, 1), (3, 4), (16, 2)])
def test_overlapping_entries(spark, shards, splits):
    rng = np.random.default_rng(1)
    letters = list("ab구동")
    entries = [(f"k{i % 3}", "".join(rng.choice(letters, rng.integers(1, 5)))) for i in range(120)] + [("k0", ""), ("k1", None), ("k0", "a"), ("k2", "a"), ("k2", "송파구 가락동"), ("k2", "송파구")]
    texts = [(i, "".join(rng.choice(letters, rng.integers(0, 14)))) for i in range(80)] + [(100, "서울 송파구 가락동"), (101, None), (102, "zzz"), (None, "ab")]
    q, e = spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame(entries, "kind string, entry string")
    want = {(i, k, x) for i, t in texts for k, x in entries if t and x and x in t}
    got = [(r.key, r.kind, r.entry) for r in dictionary.contained(q, e, "id", "t", shards=shards, splits=splits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = {}
    for i, k, x in want:
        best[(i, k)] = min(best.get((i, k), x), x, key=lambda y: (-len(y), y))
    got = dictionary.longest_entries(q, e, "id", "t", ["k0", "k1", "k2"], shards=shards, splits=splits).collect()
    assert {(r.id, k): r[k] for r in got for k in ("k0", "k1", "k2") if r[k] is not None} == best


def test_large_dictionary_has_no_nested_loop_and_no_job(spark):
    entries = spark.range(300_000).select(F.lit("n").alias("kind"), F.concat(F.lit("단지"), F.col("id").cast("string"), F.lit("호")).alias("entry"))
    texts = spark.createDataFrame([(1, "단지12호 옆 단지299999호"), (2, "단지300001호"), (3, "단지1234567호")], "id long, t string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    out = dictionary.longest_entries(texts, entries, "id", "t", ["n"])
    assert not tracker.getJobIdsForGroup("plan")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.n for r in out.collect()} == {1: "단지299999호"}
    spark.sparkContext.setJobGroup("rest", "rest")


def brute(questions, docs, k, boosts):
    out = set()
    for qid, t in questions:
        scored = {}
        for doc, content, value in docs:
            s = 0.0
            if words(content) and words(t):
                s = len(words(content) & words(t)) + sum(w for w in boosts if value and value in (t or ""))
            scored[doc] = max(scored.get(doc, 0.0), s)
        for rank, (doc, s) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((qid, rank, doc, s))
    return out


@pytest.mark.parametrize("boost", [[], [2.0], [0.5]])
def test_top_k_is_exact(spark, boost):
    rng = np.random.default_rng(2)
    p = 1.0 / np.arange(1, 61)
    draw = lambda n: " ".join(f"w{x}" for x in rng.choice(60, n, p=p / p.sum()))
    docs = [(i, draw(int(rng.integers(1, 30))), ["en", "de", "w3", None, ""][i % 5]) for i in rng.permutation(400).tolist()] + [(900, None, "en"), (901, "", "en"), (902, "!!", "de")]
    questions = [(i, draw(int(rng.integers(1, 14))) + [" en", "", " w3", " de zz"][i % 4]) for i in range(40)] + [(100, "none known"), (101, ""), (102, None), (103, "w0"), (104, "en"), (105, "!? de")]
    d, q = spark.createDataFrame(docs, "id long, body string, lang string").repartition(4), spark.createDataFrame(questions, "q long, t string")
    got = retrieve.top_k(q, d, 3, qid="q", question="t", doc="id", content="body", boosts={"lang": boost[0]} if boost else None)
    assert {tuple(r) for r in got.select("qid", "rank", "doc", "score").collect()} == brute(questions, docs, 3, boost)


def test_frequent_tokens_are_never_read(spark):
    docs = spark.range(6000).select("id", F.concat(F.lit("the of "), F.concat_ws(" ", *(F.concat(F.lit(f"x{j}"), (F.col("id") * (j + 3) % 997).cast("string")) for j in range(6)))).alias("body"))
    questions = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "the of x05"), (4, "the x05 x18")], "q long, t string")
    index, report = impact.build(docs, "id", "body"), []
    got = impact.search(index, questions, 3, qid="q", question="t", block_report=report)
    assert [(r.doc, r.score) for r in got.where("qid = 1").orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    rows = [(r.id, r.body, None) for r in docs.collect()]
    assert {tuple(r) for r in got.collect()} == brute([tuple(r) for r in questions.collect()], rows, 3, [])
    assert report[0] <= 40 * 3 * 4  # a multiple of k a question, of 6,000 documents that all share a token
    index.scratch.clear()
