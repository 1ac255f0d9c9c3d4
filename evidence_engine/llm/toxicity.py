"""Toxicity: a bidirectional gated recurrent network over characters and words with attention pooling.

Bytes of a word run through one bidirectional GRU and are pooled by attention; that vector, a hashed word
embedding are the word; one coordinate of the embedding begins at the word's log-odds in the sample. Windows of
words, each half over the one before, run through a second bidirectional GRU with attention pooling to a logit. All windows of the whole text
are scored; the text's logit is the largest, calibrated by a logistic curve on the sample. Everything is
trained here in numpy: first the characters on words whose log-odds are clear, then all layers on the window
of each text that scores highest.

Inputs are the text alone. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z to a-z; longer ones are
cut into pieces of ``LONGEST`` bytes, so that none of a text is left out.

Defined cases: null text is empty; a text without words is one empty window and gets a score; without usable
labels all scores are 0.5, with labels of one class that class's smoothed rate; equal texts score alike; a
column of the documents that is named as the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nets as N
from . import quality
from . import shared as S

#: Labelled rows, those of the least hash of their id, that the network is trained on at most.
SAMPLE_ROWS = 8000
#: Bytes of such a row's text at most, and of all of them together.
ROW_BYTES, SAMPLE_BYTES = 1 << 20, 64 << 20
WINDOW, STRIDE, LONGEST = 32, 16, 24
CHAR_IN, CHAR_HIDDEN, WORD_HIDDEN, EMBED, BUCKETS = 8, 10, 8, 8, 1 << 16
CHAR_OUT = 2 * CHAR_HIDDEN
INPUTS = CHAR_OUT + EMBED
#: Bytes of text that are scored together.
SLICE = 6 << 20


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, long ones cut up: starts, ends, and the number of each row's first."""
    start, end, first = S.word_bounds(data, off, S.IS_ALNUM)
    parts = -(-(end - start) // LONGEST)
    if len(parts) and parts.max() > 1:
        before = np.concatenate(([0], np.cumsum(parts)))
        k = np.arange(before[-1]) - np.repeat(before[:-1], parts)
        start, stop = np.repeat(start, parts) + k * LONGEST, np.repeat(end, parts)
        end, first = np.minimum(start + LONGEST, stop), before[first]
    return start, end, first


class Words:
    """The distinct words of a slice: bytes, lengths, hashes; and each place's word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = S.LOWER[data]
        start, end, self.first = pieces(data, off)
        self.hash, at, self.place = np.unique(S.word_hashes(data, start, end), return_index=True, return_inverse=True)
        self.length = (end - start)[at]
        cols = np.arange(int(self.length.max(initial=1)))
        held = np.append(data, np.zeros(len(cols), np.uint8))
        self.bytes = held[start[at][:, None] + cols[None, :]] if len(at) else np.zeros((0, 1), np.uint8)


class Lexicon:
    """The distinct words of all texts, and in how many texts with and without the label each stands."""

    def __init__(self, data: np.ndarray, off: np.ndarray, y: np.ndarray):
        parts = []
        for a, _, part, o in S.slices(data, off, SLICE):
            w = Words(part, o)
            n = max(len(w.hash), 1)
            pair = np.unique(np.repeat(np.arange(len(o) - 1), np.diff(w.first)) * n + w.place)
            labelled = y[a + pair // n] > 0
            counts = [np.bincount(pair[labelled == yes] % n, minlength=len(w.hash)) for yes in (True, False)]
            parts.append((w.hash, *counts, np.pad(w.bytes, ((0, 0), (0, LONGEST - w.bytes.shape[1]))), w.length))
        hashes, with_, without, codes, length = (np.concatenate(x) for x in zip(*parts))
        self.hash, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        self.bytes, self.length = codes[at], length[at]
        self.with_label, self.without = (np.bincount(place, weights=c, minlength=len(at)) for c in (with_, without))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place and length of every window; rows without words have one empty window."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][row] + k * STRIDE
    return row, begin, np.minimum(WINDOW, first[1:][row] - begin)


class Network:
    def __init__(self, rng: np.random.Generator):
        self.p = {"ce": (rng.standard_normal((256, CHAR_IN)) * 0.5).astype(N.F4), "we": (rng.standard_normal((BUCKETS, EMBED)) * 0.1).astype(N.F4)}
        for name, inputs, hidden in (("cf", CHAR_IN, CHAR_HIDDEN), ("cb", CHAR_IN, CHAR_HIDDEN), ("wf", INPUTS, WORD_HIDDEN), ("wb", INPUTS, WORD_HIDDEN)):
            self.p |= {name + k: v for k, v in N.init(rng, inputs, hidden, 3).items()}
        small = lambda n: (rng.standard_normal(n) * 0.3).astype(N.F4)
        self.p |= {"ca": small(CHAR_OUT), "cw": small(CHAR_OUT), "cbias": np.zeros(1, N.F4), "wa": small(2 * WORD_HIDDEN), "xa": np.zeros(INPUTS, N.F4), "wo": small(2 * WORD_HIDDEN), "xo": np.zeros(INPUTS, N.F4), "bias": np.zeros(1, N.F4)}
        self.p["xa"][CHAR_OUT] = self.p["xo"][CHAR_OUT] = 1
        self.slope, self.shift = 1.0, 0.0

    # Characters of distinct words.

    def chars(self, codes: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """codes (words, bytes), lengths of at least 1, all padded at the end."""
        p, steps = self.p, int(length.max())
        codes = codes[:, :steps].T.astype(np.int64)
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(N.F4)
        even = bool(mask.all())
        turn, cols = N.reversal(length, steps), np.arange(len(length))[None, :]
        back = codes[turn, cols]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = N.gru((p["ce"] @ p["cfwx"] + p["cfb"])[codes], p["cfwh"], None if even else mask, kf)
        hb = N.gru((p["ce"] @ p["cbwx"] + p["cbb"])[back], p["cbwh"], None if even else mask, kb)[turn, cols]
        h = np.concatenate([hf, hb], axis=2)
        a = _softmax(h @ p["ca"], mask)
        if keep is not None:
            keep |= {"codes": codes, "back": back, "mask": None if even else mask, "turn": turn, "cols": cols, "kf": kf, "kb": kb, "h": h, "a": a}
        return np.einsum("tb,tbh->bh", a, h)

    def chars_back(self, dv: np.ndarray, k: dict, g: dict) -> None:
        p = self.p
        dh = k["a"][:, :, None] * dv[None]
        ds = _softmax_back(np.einsum("bh,tbh->tb", dv, k["h"]), k["a"])
        dh += ds[:, :, None] * p["ca"]
        _add(g, "ca", np.einsum("tb,tbh->h", ds, k["h"]))
        df, dwf = N.gru_back(dh[:, :, :CHAR_HIDDEN], p["cfwh"], k["kf"], k["mask"])
        db, dwb = N.gru_back(dh[:, :, CHAR_HIDDEN:][k["turn"], k["cols"]], p["cbwh"], k["kb"], k["mask"])
        for d, dpre, codes, dwh in (("cf", df, k["codes"], dwf), ("cb", db, k["back"], dwb)):
            per_code = np.zeros((256, dpre.shape[2]), N.F4)
            np.add.at(per_code, codes.ravel(), dpre.reshape(-1, dpre.shape[2]))
            _add(g, d + "wh", dwh)
            _add(g, d + "b", per_code.sum(axis=0))
            _add(g, d + "wx", p["ce"].T @ per_code)
            _add(g, "ce", per_code @ p[d + "wx"].T)

    def words(self, w: Words, most: int = 4096) -> np.ndarray:
        """The input vector of each distinct word, words of like length together."""
        x = np.zeros((len(w.hash), INPUTS), N.F4)
        order = np.argsort(w.length, kind="stable")
        for a in range(0, len(order), most):
            at = order[a : a + most]
            x[at, :CHAR_OUT] = self.chars(w.bytes[at], w.length[at])
        x[:, CHAR_OUT:] = self.p["we"][(w.hash % np.uint64(BUCKETS)).astype(np.int64)]
        return x

    # Windows of words.

    def windows(self, x: np.ndarray, place: np.ndarray, begin: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits. x: vectors of distinct words; place: word of each place."""
        p, steps = self.p, max(1, int(length.max(initial=0)))
        t = np.arange(steps)[:, None]
        mask = (t < length[None, :]).astype(N.F4)
        ids = place[np.where(t < length[None, :], begin[None, :] + t, 0)] if len(place) else np.zeros(mask.shape, np.int64)
        if not len(x):
            x = np.zeros((1, INPUTS), N.F4)
        turn, cols = N.reversal(length, steps), np.arange(len(length))[None, :]
        kf, kb = ([], []) if keep is not None else (None, None)
        even = None if mask.all() else mask
        hf = N.gru((x @ p["wfwx"] + p["wfb"])[ids], p["wfwh"], even, kf)
        hb = N.gru((x @ p["wbwx"] + p["wbb"])[ids[turn, cols]], p["wbwh"], even, kb)[turn, cols]
        h = np.concatenate([hf, hb], axis=2)
        xs = (x @ p["xo"])[ids]
        a = _softmax(h @ p["wa"] + (x @ p["xa"])[ids], mask)
        value = h @ p["wo"] + xs
        if keep is not None:
            keep |= {"ids": ids, "mask": mask, "even": even, "turn": turn, "cols": cols, "kf": kf, "kb": kb, "h": h, "a": a, "value": value, "x": x}
        return (a * value).sum(axis=0) + p["bias"]

    def windows_back(self, dlogit: np.ndarray, k: dict, g: dict) -> np.ndarray:
        """Gradient of x."""
        p, x, ids = self.p, k["x"], k["ids"]
        dvalue = k["a"] * dlogit[None, :]
        ds = _softmax_back(k["value"] * dlogit[None, :], k["a"])
        dh = dvalue[:, :, None] * p["wo"] + ds[:, :, None] * p["wa"]
        _add(g, "wo", np.einsum("tb,tbh->h", dvalue, k["h"]))
        _add(g, "wa", np.einsum("tb,tbh->h", ds, k["h"]))
        _add(g, "bias", dlogit.sum(keepdims=True))
        dx = np.zeros_like(x)
        for name, d in (("xo", dvalue), ("xa", ds)):
            per = np.bincount(ids.ravel(), weights=d.ravel(), minlength=len(x)).astype(N.F4)
            _add(g, name, per @ x)
            dx += per[:, None] * p[name]
        df, dwf = N.gru_back(dh[:, :, :WORD_HIDDEN], p["wfwh"], k["kf"], k["even"])
        db, dwb = N.gru_back(dh[:, :, WORD_HIDDEN:][k["turn"], k["cols"]], p["wbwh"], k["kb"], k["even"])
        for name, dpre, at, dwh in (("wf", df, ids, dwf), ("wb", db, ids[k["turn"], k["cols"]], dwb)):
            per = np.zeros((len(x), dpre.shape[2]), N.F4)
            np.add.at(per, at.ravel(), dpre.reshape(-1, dpre.shape[2]))
            _add(g, name + "wh", dwh)
            _add(g, name + "b", per.sum(axis=0))
            _add(g, name + "wx", x.T @ per)
            dx += per @ p[name + "wx"].T
        return dx

    def best(self, data: np.ndarray, off: np.ndarray, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of a slice: its largest window logit, and that window's first place and length."""
        w = Words(data, off)
        x = self.words(w)
        row, begin, length = windows(w.first)
        z = np.concatenate([self.windows(x, w.place, begin[a : a + most], length[a : a + most]) for a in range(0, len(row), most)]) if len(row) else np.zeros(0, N.F4)
        order = np.lexsort((-z, row))
        top = order[np.searchsorted(row, np.arange(len(off) - 1))] if len(row) else order
        return z[top], begin[top], length[top]

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        parts = [self.best(part, o)[0] for _, _, part, o in S.slices(data, off, SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0, N.F4)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return N.sigmoid(self.slope * self.logits(data, off).astype(float) + self.shift)


def _softmax(s: np.ndarray, mask: np.ndarray) -> np.ndarray:
    s = np.where(mask > 0, s, -np.inf)
    top = s.max(axis=0, keepdims=True)
    e = np.exp(s - np.where(np.isfinite(top), top, 0))
    return e / np.maximum(e.sum(axis=0, keepdims=True), 1e-9)


def _softmax_back(da: np.ndarray, a: np.ndarray) -> np.ndarray:
    return a * (da - (a * da).sum(axis=0, keepdims=True))


def _add(g: dict, name: str, value: np.ndarray) -> None:
    g[name] = g[name] + value if name in g else value


def constant(ones: float, rows: int) -> Network:
    model = Network(np.random.default_rng(0))
    model.slope, rate = 0.0, (ones + 1) / (rows + 2)
    model.shift = float(np.log(rate / (1 - rate)))
    return model


def trained(texts: list[str], y: np.ndarray, epochs: int = 5, seed: int = 3, begin_at_odds: float = 1.0) -> Network:
    """begin_at_odds 0: the embedding begins without what the labels say of single words."""
    y = np.asarray(y, float)
    if not len(y) or y.sum() in (0, len(y)):
        return constant(float(y.sum()), len(y))
    rng = np.random.default_rng(seed)
    model = Network(rng)
    raw = [t.encode("utf-8", "replace") for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = Lexicon(data, off, y)
    odds = np.log((w.with_label + 0.5) / (y.sum() + 1)) - np.log((w.without + 0.5) / (len(y) - y.sum() + 1))
    texts_with = w.with_label + w.without
    enough = texts_with >= 4
    slot = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
    best = np.zeros(BUCKETS)
    np.add.at(best, slot, texts_with)  # a slot that several words share goes by the common ones
    share = enough & (texts_with > 0.5 * best[slot])
    model.p["we"][:, 0] = 0
    model.p["we"][slot[share], 0] = np.clip(odds[share] / 4, -1, 1.5) * begin_at_odds
    _learn_characters(model, w, np.flatnonzero(enough), odds, rng)
    _learn_windows(model, data, off, y, epochs, rng)
    z = model.logits(data, off).astype(float)
    model.slope, model.shift = _calibrated(z, y)
    return model


def _learn_characters(model: Network, w: Lexicon, at: np.ndarray, odds: np.ndarray, rng: np.random.Generator, steps: int = 500) -> None:
    """The character layers, on whether a word's log-odds are high."""
    y = (odds[at] > 1.5).astype(N.F4)
    high, low = at[y > 0], at[y == 0]
    if not len(high) or not len(low):
        return
    names = [k for k in model.p if k[0] == "c"]
    adam = N.Adam({k: model.p[k] for k in names}, 0.01)
    for step in range(steps):
        adam.rate = 0.01 * (1 - 0.9 * step / steps)
        own = np.concatenate([rng.choice(high, 96), rng.choice(low, 160)])
        target = np.repeat([1.0, 0.0], [96, 160]).astype(N.F4)
        keep: dict = {}
        v = model.chars(w.bytes[own], w.length[own], keep)
        d = (N.sigmoid(v @ model.p["cw"] + model.p["cbias"]) - target) / len(own)
        g = {"cw": d @ v, "cbias": d.sum(keepdims=True)}
        model.chars_back(d[:, None] * model.p["cw"], keep, g)
        adam.step(g)
    model.p["xo"][:CHAR_OUT] = model.p["xa"][:CHAR_OUT] = 0.5 * model.p["cw"]


def _learn_windows(model: Network, data: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """All layers, on each text's highest window; of texts without the label also on one at random."""
    adam = N.Adam({k: v for k, v in model.p.items() if k not in ("cw", "cbias")}, 0.004)
    for epoch in range(epochs):
        adam.rate = 0.004 * 0.7**epoch
        jobs = []
        ones, zeros = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
        turn = np.concatenate([ones, rng.permutation(zeros)[: 2 * len(ones) + 64]])
        own_off = np.concatenate(([0], np.cumsum(np.diff(off)[turn])))
        own = np.concatenate([data[off[i] : off[i + 1]] for i in turn])
        for a, b, part, o in S.slices(own, own_off, SLICE):
            w = Words(part, o)
            _, begin, length = model.best(part, o)
            jobs += [(w, begin[i], length[i], y[turn[a + i]]) for i in range(b - a) if length[i]]
            row, begin, length = windows(w.first)
            for i in rng.permutation(len(row))[: 2 * (b - a)]:
                if y[turn[a + row[i]]] == 0 and length[i]:
                    jobs.append((w, begin[i], length[i], 0.0))
        ones = [j for j in jobs if j[3] > 0]
        zeros = [j for j in jobs if j[3] == 0]
        zeros = [zeros[i] for i in rng.permutation(len(zeros))[: 3 * len(ones) + 64]]
        jobs = ones + zeros
        order = rng.permutation(len(jobs))
        for a in range(0, len(order), 64):
            own = [jobs[i] for i in order[a : a + 64]]
            _step(model, adam, own)


def _step(model: Network, adam: N.Adam, own: list) -> None:
    hashes = np.concatenate([w.hash[w.place[b : b + n]] for w, b, n, _ in own])
    _, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    width = max(w.bytes.shape[1] for w, *_ in own)
    codes = np.concatenate([np.pad(w.bytes[w.place[b : b + n]], ((0, 0), (0, width - w.bytes.shape[1]))) for w, b, n, _ in own])[at]
    lengths = np.concatenate([w.length[w.place[b : b + n]] for w, b, n, _ in own])[at]
    hashes = hashes[at]
    n = np.array([n for _, _, n, _ in own])
    target = np.array([t for *_, t in own], N.F4)
    x = np.zeros((len(at), INPUTS), N.F4)
    kc: dict = {}
    x[:, :CHAR_OUT] = model.chars(codes, lengths, kc)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    x[:, CHAR_OUT:] = model.p["we"][bucket]
    kw: dict = {}
    z = model.windows(x, place, np.cumsum(n) - n, n, kw)
    g: dict = {}
    dx = model.windows_back(((N.sigmoid(z) - target) / len(own)).astype(N.F4), kw, g)
    model.chars_back(dx[:, :CHAR_OUT], kc, g)
    g["we"] = np.zeros_like(model.p["we"])
    np.add.at(g["we"], bucket, dx[:, CHAR_OUT:])
    adam.step(g)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over z, with a little ridge, by Newton steps."""
    mean, spread = z.mean(), z.std() + 1e-6
    u = np.column_stack([(z - mean) / spread, np.ones(len(z))])
    w = np.zeros(2)
    for _ in range(50):
        p = N.sigmoid(u @ w)
        g = u.T @ (p - y) + 1e-2 * w
        h = (u * (p * (1 - p))[:, None]).T @ u + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Network:
    sample = quality.labelled_sample(docs, labels, label, rows).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("n") <= ROW_BYTES)
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(rows)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0))  # over the sample's rows
    sample = sample.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("text", "y").toPandas()
    return trained(sample["text"].fillna("").tolist(), sample["y"].to_numpy(float))


def scored(docs: DataFrame, model: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents' columns without the text, and the score of the whole text."""
    S.arrow_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, score_col)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest), f"`{score_col}` double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sent.value.scores(*S.flat(batch.column(len(rest)))))], names=[*rest, score_col])

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return rows.select("doc_id", (S.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
