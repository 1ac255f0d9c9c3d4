"""Periodic runs of words, found by branching tandem repeats in suffix trees.

The words of each text get a suffix tree of their own (many texts are worked on together: words of different
texts are different symbols). Suffixes are sorted by doubling, neighbours' common prefixes follow from the
ranks of each doubling, and the tree's inner nodes are the maximal intervals of suffixes with a common prefix
of the node's depth. As Stoye and Gusfield have it, a tandem repeat ww with another word after it is a pair of
leaves i and i + |w| whose deepest common node has depth |w|; one of the two lies below a child of that node
that is not its largest. So the leaf lists of all children but the largest are gone through, every leaf p of
such a list looks for p + depth and p - depth in the node's interval, and n log n looks find all of them.
Each repeat is then rotated to the left as long as the words agree, which gives the whole maximal run; repeats
of one run with multiples of its period merge into that of the smallest period.

Texts are rows of their own: nothing is shuffled, and a text of n words needs memory in proportion to n.

Defined cases: null and empty texts have no words and no runs; repeated rows get equal results; a null key is
kept as it is; an empty table gives no rows; no other column than key, text and the cut of ``repeat`` is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Words of the shortest run.
LEAST = 12
#: Bytes of whole texts that are worked on together.
SLICE = 1 << 21

_RUN = "start bigint, length bigint, period bigint"
_RUN_ARROW = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words of one row and for no others."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.empty(2 * len(start) + 1, np.int64)
    ends[0:-1:2], ends[1::2], ends[-1] = start, end, end[-1]  # words and what stands between them, by turns
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 2, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    word = np.asarray(both.dictionary_encode().indices)[::2].astype(np.int64)
    return row * (int(word.max()) + 1) + word


def sorted_suffixes(code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and ranks by the first 1, 2, 4 ... words (equal ranks: equal words). end: where the row of each word ends."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = code[order[1:]] != code[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, size = [rank], 1
    while True:
        tied = ~fresh | np.append(~fresh[1:], False)
        slot = np.flatnonzero(tied)
        if not len(slot):
            return order, ranks
        at = order[slot]
        after = np.where(at + size < end[at], rank[np.minimum(at + size, n)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slot] = at
        new = np.ones(len(slot), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[slot] = new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slot, 0))
        ranks.append(rank)
        size *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Of each suffix with the one before it, with a zero at both ends."""
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[pair - 1], order[pair]
    deepest = np.zeros(len(pair), np.int64)  # the last doubling in which both are still alike
    alive = np.arange(len(pair))
    for k in range(1, len(ranks)):
        alive = alive[ranks[k][a[alive]] == ranks[k][b[alive]]]
        deepest[alive] = k
        if not len(alive):
            break
    length = np.left_shift(1, deepest)
    by = np.argsort(-deepest, kind="stable")
    upto = np.searchsorted(-deepest[by], 0, side="left")
    for k in range(int(deepest.max(initial=0)) - 1, -1, -1):
        some = by[: np.searchsorted(-deepest[by[:upto]], -k, side="left")]
        x, y = a[some] + length[some], b[some] + length[some]
        more = ranks[k][np.minimum(x, n)] == ranks[k][np.minimum(y, n)]
        length[some[more]] += 1 << k
    out[pair] = length
    return out


def _nearest_smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place of ``at`` the nearest one in that direction with a smaller value: pointers that jump over pointers."""
    to = np.arange(len(lcp)) + step
    left = at
    while len(left):
        left = left[lcp[to[left]] >= lcp[left]]
        to[left] = to[to[left]]
    return to[at]


def tandem_repeats(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all branching tandem repeats."""
    n, none = len(order), np.zeros(0, np.int64)
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return none, none
    low, high = _nearest_smaller(lcp, inner, -1), _nearest_smaller(lcp, inner, 1)
    _, first, number = np.unique(low * (n + 1) + high, return_index=True, return_inverse=True)
    nodes = len(first)
    node_at = np.full(n + 1, -1, np.int64)
    node_at[inner] = number
    depth = lcp[inner[first]]
    # Inner nodes first, then the leaves; lo and hi are the first and last suffix below each.
    lo = np.concatenate((low[first], np.arange(n)))
    hi = np.concatenate((high[first] - 1, np.arange(n)))
    parent = node_at[np.where(lcp[lo] >= lcp[hi + 1], lo, hi + 1)]
    below, size = np.flatnonzero(parent >= 0), hi - lo + 1
    most = np.zeros(nodes, np.int64)
    np.maximum.at(most, parent[below], size[below])
    large = below[size[below] == most[parent[below]]]
    largest = np.full(nodes, -1, np.int64)
    largest[parent[large]] = large
    top = np.arange(len(lo))  # the highest of the chain of largest children that ends in each
    large = large[largest[parent[large]] == large]
    top[large] = parent[large]
    while True:
        further = top[top]
        if np.array_equal(further, top):
            break
        top = further
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    places, periods = [], []
    leaf, child = np.arange(n), top[nodes:]
    while True:
        alive = parent[child] >= 0
        leaf, child = leaf[alive], child[alive]
        if not len(leaf):
            break
        node = parent[child]
        p, d = order[leaf], depth[node]
        for other in (p + d, p - d):
            there = (other >= 0) & (other < n)
            r = rank[np.where(there, other, 0)]
            hit = there & (r >= lo[node]) & (r <= hi[node]) & ((r < lo[child]) | (r > hi[child]))
            places.append(np.minimum(p, other)[hit])
            periods.append(d[hit])
        child = top[node]
    return np.concatenate(places or [none]), np.concatenate(periods or [none])


def maximal_runs(code: np.ndarray, place: np.ndarray, period: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of at least ``least`` words that the repeats belong to, each once."""
    end = place + 2 * period
    start, turning, step = place.copy(), np.arange(len(place)), 4
    while len(turning):
        back = start[turning, None] - 1 - np.arange(step)
        same = (back >= 0) & (code[np.maximum(back, 0)] == code[np.maximum(back, 0) + period[turning, None]])
        whole = same.all(axis=1)
        start[turning] -= np.where(whole, step, same.argmin(axis=1))
        turning, step = turning[whole], min(4 * step, 256)
    long = np.flatnonzero(end - start >= least)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs_of_rows(code: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in word numbers of the whole slice; first: number of each row's first word, and the count."""
    if not len(code):
        return (np.zeros(0, np.int64),) * 3
    order, ranks = sorted_suffixes(code, np.repeat(first[1:], np.diff(first)))
    lcp = common_prefixes(order, ranks)
    del ranks
    start, end, period = maximal_runs(code, *tandem_repeats(order, lcp), least)
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _detect(least: int):
    """mapInArrow function: (key, text, cut) to (key, n_words, runs, collapsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = S.flat(batch.column(1))
            cuts = batch.column(2).to_numpy(zero_copy_only=False)
            for row, row_end, part, part_off in S.slices(data, off, SLICE):
                yield _slice(batch.column(0).slice(row, row_end - row), part, part_off, cuts[row:row_end], least)

    return run


def _slice(keys: pa.Array, part: np.ndarray, off: np.ndarray, cuts: np.ndarray, least: int) -> pa.RecordBatch:
    start, end, first = S.word_bounds(part, off, S.IS_TOKEN)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    source = np.arange(len(row))  # which word stands at each place
    for i in np.flatnonzero((cuts == cuts) & (count > 0)):  # noqa: PLR0124  NaN: not repeated
        n, g = int(count[i]), int(cuts[i])
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    code = symbols(part, start, end, row)[source]
    s, e, q = runs_of_rows(code, first, least)
    of = row[s] if len(s) else np.zeros(0, np.int64)
    dropped = np.zeros(len(row) + 1, np.int64)
    np.add.at(dropped, s + q, 1)
    np.add.at(dropped, e, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    raw, changed = part.tobytes(), set(np.unique(of).tolist()) | set(np.flatnonzero(cuts == cuts).tolist())  # noqa: PLR0124
    texts = []
    for i in range(len(count)):
        words = raw[off[i] : off[i + 1]].split()  # bytes: exactly U+0020 and U+0009 to U+000D
        if i in changed:
            lo, hi = first[i], first[i + 1]
            words = [words[j] for j in (source[lo:hi][kept[lo:hi]] - lo).tolist()]
        texts.append(b" ".join(words))
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (s - first[of], e - s, q)], fields=list(_RUN_ARROW))
    return pa.RecordBatch.from_arrays([keys, pa.array(count.astype(np.int64)), S.lists(runs, np.bincount(of, minlength=len(count))), pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str, text: str, least: int = LEAST, repeat: Column | None = None) -> DataFrame:
    """(key, n_words, runs by start and then period, collapsed): a word that repeats an earlier period of a run is dropped from collapsed.

    ``repeat``: where this integer g is not null, the words from a = g mod n on are first replaced by repetitions of the
    1 + (n - a) div (3 + g mod 8) words that begin at a.
    """
    S.arrow_batches(docs.sparkSession, mb=4)
    cut = F.lit(None).cast("double") if repeat is None else repeat.cast("double")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), cut.alias("cut"))
    return rows.mapInArrow(S.trimmed(_detect(least)), f"key {dict(rows.dtypes)['key']}, n_words bigint, runs array<struct<{_RUN}>>, collapsed string")


def op12(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with repetitions written into them; the longest run and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs(docs, "doc_id", "text", LEAST, F.when(h % 10 == 0, F.floor(h / 10)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]).cast("array<string>"), ","), F.lit("\n"))), "")
    rows = found.select("key", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return rows.select(
        F.col("key").cast("bigint").alias("doc_id"), "n_runs", (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"),
        F.floor(F.col("b.l") * 1000 / -F.col("b.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
