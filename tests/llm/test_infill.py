"""Fill-in-the-middle against a brute-force version, with all planes, nulls, empty and long texts, markers, repeated rows, clashing columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import infill


def brute(i, t):
    """(n, form, prefix units, middle units, output) in code points."""
    t = t or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", "a", "\n", "ab\r\n\tc  ", "𝒳😀é́漢字\u0000﻿", "😀" * 40, "holds <M> here", "almost <S <P >M>", "<", "<P", "S>", "x" * 300_000, "déjà vu\u0085 ü" * 50, "<" * 70, ">" * 70]


def test_against_brute_force(spark):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in range(k * 12, k * 12 + 12)] + [(5, "twice"), (5, "twice"), (None, "no key at all"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as n", "'y' as form", "'z' as unit", "0 as h")
    out = infill.transformed(df, "doc_id", "text")
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = out.collect()
    assert Counter((r.key, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got) == Counter((i, *brute(i, t)) for i, t in rows)
    assert Counter((r.key, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r.form == "plain" or r.output in (f"<P>{r.prefix}<S>{r.suffix}<M>{r.middle}", f"<S>{r.suffix}<P>{r.prefix}<M>{r.middle}")
    assert infill.transformed(df.limit(0), "doc_id", "text").isEmpty()


@pytest.mark.parametrize(
    "grammar,text,want",
    [
        ("word", " two  words\nhere ", [" ", "two  ", "words\n", "here "]),
        ("word_or_space", "a  b", ["a", "  ", "b"]),
        ("line", "a\n\nb\n", ["a\n", "\n", "b\n"]),
        ("paragraph", "a\nb\n\nc", ["a\nb\n\n", "c"]),
        ("sentence", "One. Two! 三。四", ["One. ", "Two! ", "三。", "四"]),
        ([("[a-z]", "[A-Z]")], "camelCaseName", ["camel", "Case", "Name"]),
    ],
)
def test_grammars_keep_every_code_point(spark, grammar, text, want):
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r.u for r in df.select(infill.units(F.col("t"), grammar).alias("u")).collect()]
    assert got == [want, [], []] and "".join(got[0]) == text


def test_whole_table(spark, sf):
    got = infill.op13(spark, sf).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for i, t in rows:
        n, form, a, m, out = brute(i, t)
        want[(i, n, form, a, m, sha(out), sha(t or ""))] += 1
    assert Counter(tuple(r) for r in got) == want
