"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes, A-Z lower-cased, and an end byte; its context before the first byte is ``DEPTH`` end
bytes (0xFF, which UTF-8 never has). Each byte is eight binary decisions; each decision has a context tree over
the bytes before, nearest first, with a Krichevsky-Trofimov estimator at every node of depth 0 to ``DEPTH``.
The weighted probability of a node is half its own estimate and half the product of its children's, so a
decision's probability mixes the estimates of all depths by their weight on the training texts.

How it is spread: texts are dealt into chunks of about ``CHUNK`` bytes, a task each. Each chunk counts its
distinct (context, byte) grams, and the counts are summed over the chunks; nothing of the corpus' statistics is
capped, and grams that only other texts have join with count zero. A task that counts holds at most ``HELD``
distinct grams and then gives out what it has, as counts of one gram in several rows add up all the same. The trees are computed in groups of the
two nearest context bytes, of which there are 65,536; the largest holds the grams of the commonest byte pair
(one or two hundredths of the distinct grams of prose). The two depths above are at most 65,280 nodes, which
go to the driver and to all machines. Each gram's log-probability goes back to the chunks
that have it, and the chunk's texts come after its grams in one sorted stream: a task holds the chunk's distinct
grams and one batch of its texts. Word counts of the base score take the same way.

Defined cases: null text is empty: its end byte and end token alone; without training texts every decision
has probability 1/2; repeated rows are counted as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

DEPTH, CHUNK, EDGE = 5, 48 << 20, 0xFF
#: Distinct grams or words that a counting task holds, and bytes of the texts it looks at together.
HELD, SLICE = 1 << 22, 1 << 20
#: What a row of a chunk is. Texts come last.
GRAM, WORD, TEXT = 0, 1, 2
LOG10 = np.log(10.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: shifted up by 12, Stirling's series, shifted back."""
    shift = np.zeros_like(x)
    for k in range(12):
        shift += np.log(x + k)
    z = x + 12
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def weigh(a: np.ndarray, b: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimate."""
    own = log_kt(a, b)
    if children is None:
        return own, np.ones_like(own)
    total = np.logaddexp(own, children) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DEPTH context bytes and the byte itself, as one number, for each byte and end; and each row's offset."""
    rows = len(off) - 1
    size = np.diff(off)
    wide = DEPTH + 1
    laid = np.full(len(data) + wide * rows, EDGE, np.uint8)
    begin = off[:-1] + wide * np.arange(rows)
    laid[np.arange(len(data)) + np.repeat(wide * np.arange(rows) + DEPTH, size)] = S.LOWER[data]
    w = laid.astype(np.uint64)
    key = np.zeros(len(laid), np.uint64)
    for j in range(wide):
        key[j:] |= w[: len(w) - j] << np.uint64(8 * j)
    symbol = np.ones(len(laid), bool)
    symbol[(begin[:, None] + np.arange(DEPTH)[None, :]).ravel()] = False
    return key[symbol], np.concatenate(([0], np.cumsum(size + 1)))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each row's first."""
    data = S.LOWER[data]
    start, end, first = S.word_bounds(data, off, S.IS_TOKEN)
    return S.word_hashes(data, start, end), first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) arrays as one, a range of keys at a time: no second copy of all of them is made."""
    longest = max((k for k, _ in parts), key=len)
    bounds = longest[rows // len(parts) :: max(1, rows // len(parts))]
    cuts = [np.concatenate(([0], np.searchsorted(k, bounds), [len(k)])) for k, _ in parts]
    for i in range(len(bounds) + 1):
        own = [(k[c[i] : c[i + 1]], n[c[i] : c[i + 1]]) for (k, n), c in zip(parts, cuts)]
        keys, counts = np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own])
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        yield keys[new], np.add.reduceat(counts, new)


class Counts:
    """Keys with their counts from many small parts: merged whenever the parts outgrow what is merged already."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = self.added = 0

    def add(self, keys: np.ndarray, learns: bool) -> None:
        if not len(keys):
            return
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n if learns else np.zeros(len(k), np.int64)))
        self.added += len(k)
        if self.added > max(1 << 19, self.merged):
            own = list(_merged(self.parts))
            self.parts = [(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))]
            self.merged, self.added = len(self.parts[0][0]), 0

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of them, sorted, a range at a time. Nothing is held afterwards."""
        parts, self.parts, self.merged, self.added = self.parts, [], 0, 0
        if parts:
            yield from _merged(parts)


def _count(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """(chunk, held_out, text), sorted by chunk, to (chunk, kind, key, n): distinct keys and training counts.

    A key comes again in a chunk of more than ``most`` distinct ones.
    """
    last = None
    held = {GRAM: Counts(), WORD: Counts()}

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        for kind, own in held.items():
            if own.merged < least:
                continue
            for keys, n in own.taken():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), last, np.int32)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(S.signed(keys)), pa.array(n)], names=["chunk", "kind", "key", "n"])

    for batch in batches:
        chunk = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a == b:
                continue
            if last is not None and chunk[a] != last:
                yield from flush(0)
            last = int(chunk[a])
            out = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            data, off = S.flat(batch.column(2).slice(a, b - a))
            for i, j, part, o in S.slices(data, off, SLICE):
                for kind, of in ((GRAM, grams), (WORD, tokens)):
                    keys, first = of(part, o)
                    skip = np.repeat(out[i:j], np.diff(first))
                    held[kind].add(keys[~skip], True)
                    held[kind].add(keys[skip], False)
                yield from flush(most)
    yield from flush(0)


class Group:
    """The trees below some pairs of nearest context bytes, each with all its grams: depths 2 to DEPTH."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, n = keys[order], counts[order].astype(float)
        levels = {DEPTH: (self.keys, n)}
        for d in range(DEPTH - 1, 1, -1):
            k, at = np.unique(levels[d + 1][0] & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
            levels[d] = (k, np.bincount(at, weights=levels[d + 1][1], minlength=len(k)))
        self.p = np.zeros((len(keys), 8))  # of each gram's decisions, depths 2 and below mixed
        nodes = []  # of depth 2: nearest byte, prefix, zeros, ones, log weighted probability
        x = (self.keys & np.uint64(255)).astype(np.int64)
        for l in range(8):
            below, shift = None, np.uint64(8 - l)
            mixed = []
            for d in range(DEPTH, 1, -1):
                k, n = levels[d]
                node, at = np.unique(k >> shift, return_inverse=True)
                one = (k >> np.uint64(7 - l)) & np.uint64(1) > 0
                a = np.bincount(at, weights=np.where(one, 0, n), minlength=len(node))
                b = np.bincount(at, weights=np.where(one, n, 0), minlength=len(node))
                children = None
                if below is not None:
                    up = np.searchsorted(node, below[0] & np.uint64((1 << (8 * d + l)) - 1))
                    children = np.bincount(up, weights=below[1], minlength=len(node))
                log_w, own = weigh(a, b, children)
                mixed.append((node, a, b, own))
                below = (node, log_w)
            bit = (x >> (7 - l)) & 1
            p = None
            for d, (node, a, b, own) in zip(range(DEPTH, 1, -1), mixed):
                at = np.searchsorted(node, (self.keys & np.uint64((1 << (8 * (d + 1))) - 1)) >> shift)
                q = (np.where(bit, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
                p = q if p is None else own[at] * q + (1 - own[at]) * p
            self.p[:, l] = p
            node, a, b, _ = mixed[-1]
            prefix = (1 << l) | (node & np.uint64((1 << l) - 1)).astype(np.int64)
            nodes.append(((node >> np.uint64(l)).astype(np.int64) & 255, prefix, a, b, below[1]))
        self.nodes = [np.concatenate(x) for x in zip(*nodes)]


def _groups(batches: Iterator[pa.RecordBatch], enough: int = 1 << 17) -> Iterator[Group]:
    """Groups of (near, key, n) rows that come sorted by near: whole pairs of nearest bytes, together until there are enough grams."""
    last, held, keys, counts = None, 0, [], []
    for batch in batches:
        near, key, n = (batch.column(c).to_numpy() for c in ("near", "key", "n"))
        cut = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(near)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a == b:
                continue
            if last is not None and near[a] != last and held >= enough:
                yield Group(np.concatenate(keys), np.concatenate(counts))
                held, keys, counts = 0, [], []
            last = int(near[a])
            held += b - a
            keys.append(key[a:b].view(np.uint64))
            counts.append(n[a:b])
    if keys:
        yield Group(np.concatenate(keys), np.concatenate(counts))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        c1, prefix, a, b, w = group.nodes
        yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int32()), pa.array(prefix, pa.int32()), pa.array(a), pa.array(b), pa.array(w)], names=["c1", "prefix", "a", "b", "w"])


def top_nodes(rows: list) -> dict[str, np.ndarray]:
    """Depths 1 and 0 from (c1, prefix, a, b, sum of the children's w): at most 256 * 255 rows."""
    a, b, w = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        a[r.c1, r.prefix], b[r.c1, r.prefix], w[r.c1, r.prefix] = r.a, r.b, r.w
    log_w, own1 = weigh(a, b, w)
    a0, b0 = a.sum(axis=0), b.sum(axis=0)
    _, own0 = weigh(a0, b0, log_w.sum(axis=0))
    return {"a1": a, "b1": b, "own1": own1, "a0": a0, "b0": b0, "own0": own0}


def gram_logs(group: Group, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each gram's byte."""
    x = (group.keys & np.uint64(255)).astype(np.int64)
    c1 = ((group.keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(x))
    for l in range(8):
        prefix, bit = (1 << l) | (x >> (8 - l)), (x >> (7 - l)) & 1
        p = group.p[:, l]
        for a, b, own in ((top["a1"][c1, prefix], top["b1"][c1, prefix], top["own1"][c1, prefix]), (top["a0"][prefix], top["b0"][prefix], top["own0"][prefix])):
            p = own * (np.where(bit, b, a) + 0.5) / (a + b + 1) + (1 - own) * p
        total += np.log10(p)
    return total


def _models(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(S.signed(group.keys)), pa.array(gram_logs(group, top.value))], names=["key", "value"])

    return run


def _looked_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of many batches, sorted by key. Empties the list."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    key = np.concatenate([k for k, _ in parts])
    val = np.concatenate([v for _, v in parts])
    parts.clear()
    order = np.argsort(key)
    return key[order], val[order]


def score_texts(rows: pa.StructArray, value: dict[int, tuple[np.ndarray, np.ndarray]], total: float, unseen: float, ends: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) of a chunk scored by the sorted values of all its grams (logarithms) and words (counts).

    total: training tokens; unseen: log10 of the base probability's denominator; ends: training texts.
    """
    ids, held_out, text = rows.flatten()
    data, off = S.flat(text)
    end_log = np.log10(ends + 1) - unseen
    for i, j, part, o in S.slices(data, off, SLICE):
        g, first = grams(part, o)
        run = np.concatenate(([0.0], np.cumsum(value[GRAM][1][np.searchsorted(value[GRAM][0], g)])))
        score = run[first[1:]] - run[first[:-1]]
        w, first = tokens(part, o)
        c = value[WORD][1][np.searchsorted(value[WORD][0], w)] if len(w) else np.zeros(0)
        run = np.concatenate(([0.0], np.cumsum(np.log10(c + 1) - unseen)))
        base = run[first[1:]] - run[first[:-1]] + end_log
        seen = np.concatenate(([0], np.cumsum(c > 0)))
        known = seen[first[1:]] - seen[first[:-1]] + int(ends > 0)
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids.slice(i, j - i), "held_out": held_out.slice(i, j - i), "n_tokens": pa.array(np.diff(first) + 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(j - i, int(total))),
            "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / (np.diff(o) + 1)),
        })


def _scores(total: float, unseen: float, ends: float):
    """(part, key, value, row), sorted by part = 3 * chunk + kind, to the scores of the texts: a chunk's values first, then its texts, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, value = None, {GRAM: [], WORD: []}, {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                chunk, kind = divmod(int(part[a]), 3)
                if chunk != last:
                    last, value = chunk, {}
                if kind != TEXT:
                    held[kind].append((batch.column(1).to_numpy()[a:b].view(np.uint64).copy(), batch.column(2).to_numpy()[a:b].copy()))
                    continue
                if not value:
                    value = {k: _looked_up(parts) for k, parts in held.items()}
                yield from score_texts(batch.column(3).slice(a, b - a), value, total, unseen, ends)

    return run


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, modulus: int = 7, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=8)
    rows = docs.select(F.col(id_col).alias("id"), (S.crc_mod(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    size = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(~F.col("held_out")).alias("ends")).first()
    chunks = max(1, -(-(size.size or 0) // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    counted = dealt.select("chunk", "held_out", "text").repartitionById(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(S.trimmed(_count), "chunk int, kind int, key bigint, n bigint")
    counted = S.settled(counted, "ctw-counts")
    words = S.settled(counted.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "ctw-words")
    sums = words.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = int(size.ends or 0)
    total, vocabulary = int(sums.n or 0) + ends, sums.v + int(ends > 0)
    every = counted.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")).withColumn("near", F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int"))
    every = S.settled(every.repartition("near").sortWithinPartitions("near"), "ctw-grams")
    grouped = every.select("near", "key", "n").repartition("near").sortWithinPartitions("near")
    top = grouped.mapInArrow(S.trimmed(_tops), "c1 int, prefix int, a double, b double, w double").groupBy("c1", "prefix").agg(*(F.sum(c).alias(c) for c in "abw"))
    model = spark.sparkContext.broadcast(top_nodes(top.collect()))  # at most 256 * 255 rows
    logs = S.settled(grouped.mapInArrow(S.trimmed(_models(model)), "key bigint, value double"), "ctw-model")
    values = logs.select(F.lit(GRAM).alias("kind"), "key", "value").union(words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")))
    part = lambda of: (F.col("chunk").cast("long") * 3 + of).alias("part")
    back = counted.select("chunk", "kind", "key").join(values.hint("merge"), ["kind", "key"]).select(part(F.col("kind")), "key", "value", F.lit(None).alias("row"))
    texts = dealt.select(part(TEXT), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), F.struct("id", "held_out", "text").alias("row"))
    laid = back.union(texts).repartitionById(chunks, F.expr("int(part div 3)")).sortWithinPartitions("part")
    unseen = float(np.log10(total + vocabulary + 1))
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return laid.mapInArrow(S.trimmed(_scores(total, unseen, ends)), out)


def op3(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
