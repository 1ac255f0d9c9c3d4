"""Induced suffix sorting and the removal of repeated strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import induced, repeats


def brute_array(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def alike(a, b):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return min(k, induced.CAP)

    return order, [0] + [alike(a, b) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 40])
def test_suffix_arrays(letters, tmp_path):
    rng = np.random.default_rng(letters)
    for trial in range(60):
        t = rng.integers(1, letters + 1, rng.integers(1, 120))
        if trial % 4 == 0:
            t = np.tile(t[: max(1, len(t) // 6)], 8)[: len(t)]
        t = np.append(t, 0).astype(np.int32)
        place, lcp = induced.suffix_array(t, letters + 1, str(tmp_path))
        assert (place.tolist(), lcp.tolist()) == brute_array(t.tolist())


def test_long_prefixes_are_capped(tmp_path):
    t = np.array([1, 2, 3] * 300 + [4] * 600 + [0], np.int32)
    place, lcp = induced.suffix_array(t, 5, str(tmp_path))
    assert (place.tolist(), lcp.tolist()) == brute_array(t.tolist())


def brute(rows, length):
    """(key, n_bytes, n_removed, n_spans, kept) of (key, text) rows."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                if i + length <= len(r):
                    gone[i + length] -= 1
        cover = np.cumsum(gone)[: len(r)] > 0
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((key, len(r), int(cover.sum()), spans, bytes(b for b, c in zip(r, cover) if not c)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)] + ["漢字", "é", "😀"]
    draw = lambda n: " ".join(rng.choice(words, n))
    passage, line, edge = draw(70), draw(12), draw(60)
    out = [(None, draw(80)), (1, None), (2, ""), (3, "short"), (4, "a" * 1500), (5, "a" * 199), (6, "ab" * 400), (7, draw(30)), (7, draw(30)), (8, draw(5000) + passage)]
    copy = draw(90)
    out += [(10, copy), (11, copy), (11, copy), (12, copy[:-3]), (13, "x" + copy), (14, copy[50:260]), (15, copy[50:249])]
    out += [(20 + i, f"{draw(20)} {passage} {draw(20)} {line} {draw(9)}") for i in range(12)]
    out += [(40 + i, f"{draw(int(rng.integers(1, 40)))} {line}\n{line} {draw(6)} {edge[: 190 + i]} {draw(8)}") for i in range(30)]
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_against_brute_force(spark, rows, hot):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"name": F.lit("x"), "spans": F.lit(1), "seg": F.lit(2), "key": F.lit(3)}).repartition(3)
    got = repeats.deduplicated(df, "doc_id", "text", hot=hot).collect()
    assert Counter((r.key, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == Counter(brute(rows, 200))
    assert any(r.n_removed for r in got)


def test_short_windows_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.deduplicated(df, "doc_id", "text", 60, 16).collect()
    assert Counter((r.key, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == Counter(brute(rows, 60))
    assert repeats.deduplicated(df.limit(0), "doc_id", "text").isEmpty()


def test_whole_table(spark, sf):
    got = Counter(tuple(r) for r in repeats.op11(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, n, gone, spans, kept in brute(rows, 200))
    assert got == want and any(r[2] for r in want)
