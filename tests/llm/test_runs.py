"""Periodic runs against a brute-force version, with nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import runs


def brute(words, least=12):
    """All (start, length, period), straight from the definition: stretches that no neighbour extends, with no smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # a multiple of a period comes later
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def split(t):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]


def planted(i, words):
    h = zlib.crc32(("" if i is None else str(i)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def answer(i, t):
    words = planted(i, split(t))
    found = brute(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (i, len(found), s, length, q, length and 1000 * length // q, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("letters,least", [(1, 2), (2, 2), (3, 4), (6, 12)])
def test_runs_of_random_words(letters, least):
    rng = np.random.default_rng(letters)
    rows = [rng.integers(0, letters, rng.integers(0, 90)).tolist() for _ in range(150)]
    rows += [[0] * 70, [0, 1] * 40, [0, 0, 1] * 30 + [0], ([0, 1, 0, 0, 1] * 9)[:-2] + [1] * 20, []]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    code = np.concatenate([np.array(r, np.int64) + 10 * k for k, r in enumerate(rows)])
    s, e, q = runs.runs_of_rows(code, first, least)
    of = np.searchsorted(first, s, side="right") - 1
    got = [sorted(zip((s - first[of])[of == k].tolist(), (e - s)[of == k].tolist(), q[of == k].tolist())) for k in range(len(rows))]
    assert got == [brute(r, least) for r in rows]


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1000:
        a, b = b, b + a
    s, e, q = runs.runs_of_rows(np.array(b, np.int64), np.array([0, len(b)]), 2)
    assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == brute(b, 2)


def test_query_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(40)] + ["漢字", "é"]
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 40), (6, "a\x1cb a\x1cb " * 8), (6, "a\x1cb a\x1cb " * 8), (7, " ".join(rng.choice(word, 5000)) + " r s t" * 6000)]
    rows += [(k, " ".join(rng.choice(word, rng.integers(1, 200)))) for k in range(10, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "runs": F.lit(1), "cut": F.lit(2), "n_words": F.lit(3)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in runs.op12(spark, str(tmp_path)).collect())
    short = [r for r in rows if r[0] != 7]
    want = Counter(answer(*r) for r in short)
    assert not want - got
    (long,) = got - want
    assert long[0] == 7 and long[2] == 5000 and long[3:6] == (18000, 3, 6_000_000)
    kept = runs.periodic_runs(df.where("doc_id = 6"), "doc_id", "text").collect()
    assert [r.collapsed for r in kept] == ["a\x1cb"] * 2
    assert runs.periodic_runs(df.limit(0), "doc_id", "text").isEmpty()


def test_whole_table(spark, sf):
    got = Counter(tuple(r) for r in runs.op12(spark, sf).collect())
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    want = Counter(answer(i, t) for i, t in rows)
    assert not want - got and any(r[1] for r in want)
