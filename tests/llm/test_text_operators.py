"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import ctw, jaccard, licences, mixing, tokens, winnow
from evidence_engine.llm import shared as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choice(words, n))
    base, passage = draw(120), draw(14)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n"), (7, "one"), (8, "One "), (9, "two words"), (10, draw(3000)), (11, f"{draw(30)} {passage.upper()}! {draw(10)} {passage}"), (12, passage.replace(" ", ", ")), (12, passage.replace(" ", ", ")), (13, "Ünïcode déjà vu 漢字 " * 6), (None, "no id here at all")]
    rows += [(20 + i, draw(40 + i)) for i in range(30)]
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA).cache(), passage


def test_winnowing_finds_every_window(spark, docs):
    df, passage = docs
    bench = spark.createDataFrame([(1, passage), (2, "w1 w2"), (3, None), (10, ""), (None, passage), (2, "w1 w2"), (4, "vu 漢字 ünïcode")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {}
    for i, t in ((r.item_id, r.text) for r in bench.collect() if r.item_id is not None):
        w = word.findall(az(t))
        n = min(10, len(w))
        items.setdefault(str(i), set()).update(tuple(w[a : a + n]) for a in range(len(w) - n + 1) if n)
    rows, _ = winnow.decontaminate(df.withColumn("id", F.lit("clash")).withColumn("hash", F.lit(1)), bench)
    got = Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows.collect())
    want = Counter()
    for r in df.collect():
        w = word.findall(az(r.text))
        hit, which = set(), set()
        for i, grams in items.items():
            for g in grams:
                for a in range(len(w) - len(g) + 1):
                    if tuple(w[a : a + len(g)]) == g:
                        hit |= set(range(a, a + len(g)))
                        which.add(i)
        want[(r.doc_id, len(w), len(hit), tuple(sorted(which)))] += 1
    assert got == want and any(k[2] for k in want)


def test_winnowing_without_items_or_documents(spark, docs):
    df, _ = docs
    none = spark.createDataFrame([], "item_id long, text string")
    rows, spans = winnow.decontaminate(df, none)
    assert rows.count() == df.count() and rows.where("n_hit > 0").isEmpty() and spans.isEmpty()
    assert winnow.decontaminate(df.limit(0), none)[0].isEmpty()


def brute_components(rows, k, percent):
    """(sets by row, smallest id that links reach by id) of (id, text) rows; rows of one id pool."""
    sets, parent = [], {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", az(t))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, _), x in zip(rows, sets):
        for (b, _), y in zip(rows, sets):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sets, {i: root(i) for i in parent}


def edited(rng, words, families, copies, edits, longest=70):
    rows = []
    for _ in range(families):
        base = list(rng.choice(words, int(rng.integers(1, longest))))
        for _ in range(int(rng.integers(1, copies))):
            own = list(base)
            for _ in range(int(rng.integers(0, edits))):
                own[int(rng.integers(len(own)))] = "x" + str(rng.integers(1000))
            rows.append((len(rows) + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("k,percent,part_bytes", [(3, 90, jaccard.PART_BYTES), (5, 80, jaccard.PART_BYTES), (2, 50, jaccard.PART_BYTES), (3, 80, 900)])
def test_jaccard_components(spark, k, percent, part_bytes):
    rng = np.random.default_rng(k)
    rows = edited(rng, [f"v{i}" for i in range(60)], 12, 6 if part_bytes > 900 else 14, 5)
    long = " ".join(rng.choice([f"l{i}" for i in range(9000)], 30_000))
    rows += [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "A  b"), (None, "a b"), (905, long), (906, long + " more"), (905, rows[0][1]), (907, rows[1][1]), (907, rows[1][1]), (908, "other words of this very id"), (908, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "th", "cls", "n", "comp", "fam")})
    got = Counter((r.id, r.n, r.comp) for r in jaccard.near_classes(df, k=k, percent=percent, part_bytes=part_bytes)[0].collect())
    sets, comp = brute_components(rows, k, percent)
    assert got == Counter((i, len(x), comp.get(i)) for (i, _), x in zip(rows, sets))
    assert jaccard.near_classes(df.limit(0))[0].isEmpty()


def test_jaccard_families_of_unrelated_sets_stay_small(spark):
    """20,000 short texts that share a passage and some common words with each other: none has a partner, and none gets one."""
    rng = np.random.default_rng(5)
    passage = " ".join(rng.choice([f"p{i}" for i in range(50)], 12))
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 400, int(rng.integers(10, 40)))] + ([passage] if i % 3 == 0 else []))) for i in range(20_000)]
    rows += [(30_000 + i, rows[i * 700][1] + " more") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, links = jaccard.near_classes(df, k=2, percent=80)
    assert links.count() <= 20 and all(r.id - 30_000 == r.comp // 700 for r in got.where("id <> comp").collect())
    want = {i for i, t in rows[20_000:] if (lambda a, b: 100 * len(a & b) >= 80 * len(a | b))(*({tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (t.split(), t.split()[:-1])))}
    assert {r.id for r in got.where("id <> comp").collect()} == want


def test_jaccard_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(9)
    rows = edited(rng, [f"v{i}" for i in range(60)], 8, 6, 4)
    rows += [(700, None), (701, " "), (None, "x y z"), (None, "x y z"), (702, "only here these five words"), (702, "only here these five words"), (1, "text of another kind under a used id"), (703, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(7), "th": F.lit("x")})
    got = Counter((r.doc_id, r.text) for r in jaccard.stage(spark, df, "").collect())
    own = [(j, t) for j, (i, t) in enumerate(rows)]  # each row for itself, the rows of null id and without words apart
    sets, comp = brute_components([(j, t if rows[j][0] is not None else None) for j, t in own], 5, 80)
    want = Counter()
    for root in set(comp.values()):
        group = [j for j in comp if comp[j] == root]
        want[min((rows[j][0], rows[j][1]) for j in group) if sets[root] else rows[root]] += 1
    assert {i for i, _ in got} == {i for i, _ in want} and sum(got.values()) == sum(want.values())
    assert got[(None, "x y z")] == 2 and got[(702, "only here these five words")] == 1 and got[(1, "text of another kind under a used id")] == 1
    assert jaccard.stage(spark, df.limit(0), "").isEmpty()


def test_a_family_gives_fewer_links_than_it_has_sets():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 120, dtype=np.int64).astype(np.uint64)
    sets = []
    for _ in range(400):
        own = base.copy()
        at = rng.choice(120, int(rng.integers(0, 16)), replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(own))
    every = np.ones(400, bool)
    links = jaccard.linked(sets, np.arange(400), every, every, 80)
    parent = list(range(400))
    for join in (lambda: links, lambda: [(i, j) for i in range(400) for j in range(i) if jaccard.may_link(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80)]):
        pairs, parent = join(), list(range(400))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
        roots = [root(i) for i in range(400)]
        want = roots if pairs is links else want
    assert roots == want and len(links) < 400


def test_count_vector_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    vec = rng.integers(0, 6, (400, jaccard.GROUPS)).astype(np.int32)
    vec[200:] = vec[:200]
    vec[200:, :3] += 1
    n = vec.sum(axis=1).astype(np.int64)
    tree = jaccard.CountRTree(vec, n)
    for i in range(400):
        found = set(tree.order[tree.near(vec[i], int(n[i]), 80, np.ones(400, bool))].tolist())
        assert {j for j in range(400) if 180 * np.minimum(vec[i], vec[j]).sum() >= 80 * (n[i] + n[j])} <= found


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers
    import pyarrow.parquet as pq

    df, _ = docs
    odd = spark.createDataFrame([(700, "a<|endoftext|>b  c d　e\x1cf, g. h.\r\n\ni"), (701, " lead"), (702, "trail \n ")], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(odd)
    path = str(tmp_path / "t")
    tokens.write_tokens(df.withColumn("tokens", F.lit(1)), path)
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = sorted(((r.doc_id is not None, r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect())
    got = tokens.read_tokens(spark, path)
    assert sorted(((r.doc_id is not None, r.doc_id), r.tokens) for r in got.collect()) == want
    at = 0
    pos = sorted(tokens.positions(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in pos] == [k[1] for k, _ in want]
    for r in pos:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: r.ids_crc32 for r in pos}
    assert all(by_id[k[1]] == zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in want if k[1] != 12)
    some = next((tmp_path / "t").glob("*.parquet"))
    column = pq.ParquetFile(some).metadata.row_group(0).column(0)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
    plan = got.where("doc_id = 13").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,13)" in plan and "tokens#" not in plan.split("ReadSchema")[-1]
    tokens.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert tokens.positions(spark, str(tmp_path / "none")).isEmpty()


def test_piece_ids_are_the_tokenizers(spark):
    import random

    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    encode, rng = tokens.PieceEncoder(t), random.Random(4)
    bits = ["a", "b.", "c,", ".", ",", "..", " ", "  ", "\n", " \n", "\t", "é", "'s", "1", "!", " ", "　", "\x1c", "don't", "漢", "\r\n", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    raw = [x.encode() for x in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    assert {i for i, x in enumerate(texts) if tokens.WHOLE.search(x)} <= set(tokens.suspects(np.frombuffer(b"".join(raw), np.uint8), off))
    for point in ("\x1c", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000", "<|endoftext|>"):
        assert tokens.suspects(np.frombuffer(("a" + point).encode(), np.uint8), np.array([0, 1 + len(point.encode())])) == [0]
    ids, counts = encode(np.frombuffer(b"".join(raw), np.uint8), off, np.array([tokens.WHOLE.search(x) is not None for x in texts]), 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids + [7] for x in texts]


def fill(sizes, weights, most=3):
    """Targets by repeated sharing out."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[i] for i in open_)
        share = {i: (total - sum(out.values())) * weights[i] / w for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            return [out.get(i, share.get(i)) for i in range(len(sizes))]
        out |= {i: most * sizes[i] for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing_targets_and_takes(spark, docs):
    df, _ = docs
    size = lambda t: len(re.findall(mixing.SIZE, t or ""))
    clash = df.withColumns({c: F.lit("clash") for c in ("size", "source_size", "target", "skey", "start")})
    placed, spans, slots, counts = mixing.mixed(clash, block_words=8, bucket_rows=7, shard_words=500)
    rows = placed.collect()
    assert len(rows) == df.count()
    by = {}
    for r in df.collect():
        by.setdefault(r.source, []).append(size(r.text))
    names = sorted((k for k in by if k is not None)) + ([None] if None in by else [])
    want = fill([sum(by[k]) for k in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    target = {r.source: r.target for r in rows}
    assert all(abs(target[k] - v) < 1e-6 * max(v, 1) for k, v in zip(names, want))
    taken = mixing.takes(spans, slots).cache()
    assert taken.agg(F.max("times")).first()[0] <= 3
    shards = counts.agg(F.max("shard")).first()[0] + 1
    per = {r.skey: r.t for r in taken.groupBy("skey").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("t")).collect()}
    for r in rows:
        assert abs(per.get(r.skey, 0) - r.target) <= 8 * (2 + shards)
    assert slots.groupBy("skey", "slot").count().where("count > 1").isEmpty()
    covered = spans.groupBy("skey").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()
    assert {r.skey: r.n for r in covered} == {r.skey: r.source_size for r in rows if r.source_size}
    # The words that slots take from each document, one by one.
    word = {}
    for r in rows:
        for w in range(r.start, r.start + r.size):
            word[r.skey, w] = (r.skey, r.start)
    times = Counter()
    for s in slots.collect():
        for w in range(8 * s.block, 8 * s.block + 8):
            if (s.skey, w) in word:
                times[word[s.skey, w]] += 1
    got = {(r.skey, r.start): r.t for r in taken.groupBy("skey", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("t")).collect()}
    assert got == dict(times)


def test_mixing_draws_decide(spark, docs):
    df, _ = docs
    seen = []
    for seed in (0, 0, 1):
        _, spans, slots, counts = mixing.mixed(df, block_words=8, shard_words=500, seed=seed)
        drawn = {(r.shard, r.skey): r.slots for r in counts.collect()}
        filled = Counter((r.shard, r.skey) for r in slots.collect())
        assert all(filled[k] <= n for k, n in drawn.items()) and sum(drawn.values()) - sum(filled.values()) <= 2 * len(drawn)
        seen.append((drawn, sorted(map(tuple, mixing.takes(spans, slots).collect()))))
    assert seen[0] == seen[1] and seen[0][0] != seen[2][0] and seen[0][1] != seen[2][1]
    rng = np.random.default_rng(0)
    draws = np.array([mixing.drawn(np.array([2.5, 0.25, 7.0, 0.75]), rng) for _ in range(4000)])
    assert np.abs(draws.mean(axis=0) - [2.5, 0.25, 7, 0.75]).max() < 0.05 and draws[:, 2].max() == 7 and mixing.drawn(np.zeros(2), rng).tolist() == [0, 0]


def test_mixing_stage_takes_what_the_plan_takes(spark, docs):
    df, _ = docs
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    words = sum(len(re.findall(mixing.SIZE, r.text)) for r in out.collect())
    _, spans, slots, _ = mixing.mixed(df)
    assert words == mixing.takes(spans, slots).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times"))).first()[0]
    assert mixing.stage(spark, df.limit(0), "").isEmpty()


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_licences(spark):
    mit = licences.KNOWN[8][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, mit + " and more"), (4, None), (5, ""), (6, "Copyright 1999"), (7, "released under the mit licence"), (7, "released under the mit licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    got = licences.scan(df, licences.known_licences(spark)).collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "MIT-line"), (7, "MIT-line")] or sorted((r.doc_id, r.license_id or "") for r in got) == [(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, ""), (6, ""), (7, "MIT-line"), (7, "MIT-line")]
    assert licences.scan(df.limit(0), licences.known_licences(spark)).isEmpty()
    plan = licences.scan(df, licences.known_licences(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_context_trees_match_a_plain_recursion(spark):
    import math
    from collections import defaultdict

    rows = [(1, "abab cab"), (2, "abba"), (3, None), (4, "Zé ab"), (5, "xyz"), (6, "abab"), (7, ""), (6, "abab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    depth, table, kids = ctw.DEPTH, defaultdict(lambda: [0, 0]), defaultdict(set)

    def symbols(t):
        b = az(t).encode() + b"\xff"
        past = b"\xff" * depth
        return [((past + b[:j])[-depth:], x) for j, x in enumerate(b)]

    words, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            continue
        words.update(re.findall(mixing.SIZE, az(t)))
        ends += 1
        for past, x in symbols(t):
            for l in range(8):
                for d in range(depth + 1):
                    table[past[depth - d :], l, x >> (8 - l)][x >> (7 - l) & 1] += 1
    for past, l, p in table:
        if past:
            kids[past[1:], l, p].add(past)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    count = lambda *k: table[k] if k in table else (0, 0)

    def weighted(past, l, p):
        own = kt(*count(past, l, p))
        return own if len(past) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(k, l, p) for k in kids.get((past, l, p), ())))

    def prob(past, d, l, p, bit):
        node = past[depth - d :]
        n = count(node, l, p)
        q = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return q
        w = math.exp(math.log(0.5) + kt(*n) - weighted(node, l, p))
        return w * q + (1 - w) * prob(past, d + 1, l, p, bit)

    total, v = sum(words.values()) + ends, len(words) + 1
    for chunk in (8, 1 << 20):
        for r in ctw.scored(df, chunk_bytes=chunk).collect():
            t = dict(rows)[r.doc_id]
            w = re.findall(mixing.SIZE, az(t))
            assert abs(r.score - sum(math.log10(prob(past, 0, l, x >> (8 - l), x >> (7 - l) & 1)) for past, x in symbols(t) for l in range(8))) < 1e-8
            base = sum(math.log10((words[x] + 1) / (total + v + 1)) for x in w) + math.log10((ends + 1) / (total + v + 1))
            assert abs(r.base_score - base) < 1e-9 and (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(words[x] > 0 for x in w) + 1, total)
    assert ctw.scored(df.limit(0)).isEmpty()


def test_context_tree_counting_holds_distinct_grams_only():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(48, 58, 1 << 20))) for _ in range(2)]
    row = lambda t: pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([False]), pa.array([t])], names=["chunk", "held_out", "text"])
    tracemalloc.start()
    rows = [0, 0]
    for batch in ctw._count(row(texts[i % 2]) for i in range(48)):
        for kind in (ctw.GRAM, ctw.WORD):
            rows[kind] += int(batch.column(3).to_numpy()[batch.column(1).to_numpy() == kind].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [48 * ((1 << 20) + 1), 48]
    assert peak < 150e6  # 1.3 million distinct grams; 48 parts side by side take more


def test_context_tree_counts_add_up_where_they_are_given_out_early():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts, held = ["".join(map(chr, rng.integers(97, 123, 200_000))) for _ in range(12)], [i % 5 == 2 for i in range(12)]
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i // 8], pa.int32()), pa.array([held[i]]), pa.array([texts[i]])], names=["chunk", "held_out", "text"])
    once, often = (pa.Table.from_batches(ctw._count(map(batch, range(12)), most)) for most in (1 << 30, 1 << 10))
    added = lambda t: t.group_by(["chunk", "kind", "key"]).aggregate([("n", "sum")]).sort_by([(c, "ascending") for c in ("chunk", "kind", "key")])
    assert len(added(once)) == len(once) < len(often) and added(once).equals(added(often))


def test_context_tree_scores_texts_before_the_last_is_read():
    import pyarrow as pa

    texts = [f"w{i} abc" * (i % 7) for i in range(40)]
    data, off = S.flat(pa.array(texts))
    key, word = (np.unique(of(data, off)[0]) for of in (ctw.grams, ctw.tokens))
    none = pa.nulls(1, pa.struct([("id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())]))
    pulled = 0

    def batches(size):
        nonlocal pulled
        for chunk in (4, 9):
            for kind, keys in ((ctw.GRAM, key), (ctw.WORD, word)):
                for k in np.random.default_rng(chunk).permutation(keys):  # as they come: in no order
                    value = -float(k % 97) / 10 - 0.5 if kind == ctw.GRAM else float(k % 3)
                    yield pa.RecordBatch.from_arrays([pa.array([3 * chunk + kind]), pa.array([k]).view(pa.int64()), pa.array([value]), none], names=["part", "key", "value", "row"])
            for a in range(0, 40, size):
                own = range(a, min(40, a + size))
                pulled += 1
                row = pa.StructArray.from_arrays([pa.array([100 * chunk + i for i in own]), pa.array([i % 2 == 0 for i in own]), pa.array([texts[i] for i in own])], names=["id", "held_out", "text"])
                yield pa.RecordBatch.from_arrays([pa.array([3 * chunk + ctw.TEXT] * len(own)), pa.array([0] * len(own)), pa.array([0.0] * len(own)), row], names=["part", "key", "value", "row"])

    whole = [r for b in ctw._scores(50.0, 2.0, 3.0)(batches(40)) for r in b.to_pylist()]
    pulled, by_one = 0, []
    for b in ctw._scores(50.0, 2.0, 3.0)(batches(1)):
        by_one += b.to_pylist()
        assert pulled == len(by_one)
    assert [r["doc_id"] for r in whole] == [r["doc_id"] for r in by_one] == [100 * c + i for c in (4, 9) for i in range(40)]
    for a, b, t in zip(whole, by_one, texts * 2):
        g = ctw.grams(*S.flat(pa.array([t])))[0]
        assert abs(a["score"] + sum(float(k % 97) / 10 + 0.5 for k in g)) < 1e-8 and abs(a["score"] - b["score"]) < 1e-8 and abs(a["base_score"] - b["base_score"]) < 1e-8
        assert (a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["n_tokens"], b["n_known"], b["train_tokens"]) and a["n_tokens"] == len(re.findall(mixing.SIZE, t)) + 1


def test_word_hashes_do_not_depend_on_place():
    raw = b"alpha beta alpha  gamma beta"
    data, off = np.frombuffer(raw, np.uint8), np.array([0, 11, len(raw)])
    start, end, first = S.word_bounds(data, off, S.IS_TOKEN)
    whole, small = S.word_hashes(data, start, end), S.word_hashes(data, start, end, span=3)
    assert (whole == small).all() and whole[0] == whole[2] and whole[1] == whole[4] and len(set(whole.tolist())) == 3 and first.tolist() == [0, 2, 5]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
