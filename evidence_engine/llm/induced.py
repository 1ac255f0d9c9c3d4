"""Suffix arrays with common prefixes by external induced sorting.

``suffix_array`` sorts the suffixes of a sequence of symbols in the way of induced sorting: the substrings
between leftmost smaller suffixes are sorted and named, the sequence of names is sorted by recursion, and from
those suffixes all others follow. Every suffix that is taken from a priority queue in order puts the suffix that
begins one symbol earlier into the queue, so ascending order gives the larger type and descending order the
smaller one. The queue lies on disk (``BucketQueue``): its tuples are a suffix and the common prefix with the
tuple before it, kept in one stretch of a mapped file a symbol, in the order of coming.

Queues are emptied by many symbols at once: as long as no suffix of a range of symbols is followed by a symbol
of the same range, taking from that range puts nothing back into it, so its tuples are one batch of arrays.
A symbol that follows itself is a batch of its own and is taken in waves. The common prefix of two tuples that
come after one another is one more than the least common prefix between the suffixes that sent them. Values
are capped at ``CAP``.
"""

from __future__ import annotations

import os

import numpy as np

#: Common prefixes are told up to this length.
CAP = 255
#: Tuples of a batch at most, if they are of several symbols.
BATCH = 1 << 20


class BucketQueue:
    """A monotone priority queue by symbol in two mapped files. Room for each symbol is set by the known counts."""

    def __init__(self, counts: np.ndarray, folder: str, name: str):
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.filled = self.first[:-1].copy()
        size = max(1, int(self.first[-1]))
        self.place = np.asarray(np.memmap(os.path.join(folder, f"{name}-place"), np.int32, "w+", shape=size))
        self.lcp = np.asarray(np.memmap(os.path.join(folder, f"{name}-lcp"), np.uint8, "w+", shape=size))

    def push(self, symbol: np.ndarray, new: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Symbols ascend; tuples of one symbol come in their order. new: where a symbol is met first."""
        count = np.empty(len(new), np.int64)
        count[:-1], count[-1] = new[1:] - new[:-1], len(symbol) - new[-1]
        which = symbol[new]
        slot = np.arange(len(symbol)) + np.repeat(self.filled[which] - new, count)
        self.place[slot], self.lcp[slot] = place, lcp
        self.filled[which] += count

    def pop(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[low], self.first[high]
        return self.place[a:b], self.lcp[a:b]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair; of many values by a table of minima over powers of two."""
    if not len(low):
        return values[:0]
    if len(values) <= 512:
        ends = np.empty(2 * len(low), np.int64)
        ends[::2], ends[1::2] = low, high + 1
        return np.minimum.reduceat(np.append(values, values[-1]), ends)[::2]
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), values.dtype), values
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        some = (level == k).nonzero()[0]
        out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k) + 1])
    return out


def alike(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from a and from b on, up to CAP."""
    n, out = len(text), np.zeros(len(a), np.int64)
    going, step = np.arange(len(a)), 8
    while len(going):
        at = out[going, None] + np.arange(step)
        x, y = a[going, None] + at, b[going, None] + at
        same = (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        whole = same.all(axis=1)
        out[going] += np.where(whole, step, same.argmin(axis=1))
        going = going[whole & (out[going] < CAP)]
    return np.minimum(out, CAP)


def _backwards(lcp: np.ndarray) -> np.ndarray:
    """Common prefixes of the same suffixes in the opposite order."""
    return np.concatenate((np.zeros(min(1, len(lcp)), np.uint8), lcp[:0:-1]))


def _joined(symbol: np.ndarray, first_kind: int, place: np.ndarray, lcp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of two kinds, the first ``first_kind`` and the rest, in the order of symbol and kind; common prefixes set where symbols change and kinds meet."""
    by = symbol.argsort(kind="stable")
    symbol, kind, place, lcp = symbol[by], by >= first_kind, place[by], lcp[by]
    same = symbol[1:] == symbol[:-1]
    lcp[0] = 0
    lcp[1:][~same] = 0
    meet = (same & (kind[1:] != kind[:-1])).nonzero()[0]
    lcp[meet + 1] = np.minimum(run[place[meet]], run[place[meet + 1]])
    return place, lcp


def _induce(symbol: np.ndarray, wanted: np.ndarray, base: np.ndarray, base_lcp: np.ndarray, run: np.ndarray, sigma: int, folder: str, name: str) -> BucketQueue:
    """The wanted suffixes in ascending order of ``symbol``, from the sorted others; all of them are in the queue at its end."""
    at = wanted.nonzero()[0]
    queue = BucketQueue(np.bincount(symbol[at], minlength=sigma), folder, name)
    first, filled = queue.first, queue.filled
    base_first = np.concatenate(([0], np.cumsum(np.bincount(symbol[base], minlength=sigma))))
    both = first + base_first
    reach = np.full(sigma + 1, sigma, np.int64)  # least symbol that has a follower of at least that symbol
    np.minimum.at(reach, symbol[at + 1], symbol[at].astype(np.int64))
    reach = np.minimum.accumulate(reach[::-1])[::-1]
    sends = np.full(len(symbol), -1, np.int32)  # the symbol of the suffix that each one sends, if it sends one
    sends[at + 1] = symbol[at]
    del at
    low = 0
    while low < sigma:
        own = reach[low] == low
        high = low + 1 if own else max(low + 1, min(int(reach[low]), int(np.searchsorted(both, both[low] + BATCH, side="right")) - 1))
        if own:
            begin, end = int(first[low]), int(filled[low])
            while begin < end:
                wave, before = queue.place[begin:end], queue.lcp[begin:end]
                k = (sends[wave] == low).nonzero()[0]
                if len(k):
                    least = np.empty(len(k), np.uint8)
                    least[0] = min(int(run[wave[-1]]), int(run[wave[k[0]] - 1]))
                    least[1:] = np.minimum(range_minima(before, k[:-1] + 1, k[1:]), CAP - 1) + 1
                    queue.push(np.full(len(k), low), np.zeros(1, np.int64), wave[k] - 1, least)
                begin, end = end, int(filled[low])
        every, least = queue.pop(low, high)
        a, b = base_first[low], base_first[high]
        if b > a:
            if len(every):
                mine = len(every)
                every = np.concatenate((every, base[a:b]))
                every, least = _joined(symbol[every], mine, every, np.concatenate((least, base_lcp[a:b])), run)
            else:
                every, least = base[a:b], base_lcp[a:b]
        to = sends[every]
        k = (to >= (high if own else 0)).nonzero()[0]
        if len(k):
            to = to[k]
            by = to.argsort(kind="stable")
            to, k = to[by], k[by]
            differs = np.empty(len(to), bool)
            differs[0] = True
            np.not_equal(to[1:], to[:-1], out=differs[1:])
            new, again = differs.nonzero()[0], (~differs).nonzero()[0]
            share = np.empty(len(to), np.uint8)
            met = to[new]
            share[new] = filled[met] > first[met]  # a batch begins with a new symbol: one symbol in common with the tuple before
            share[again] = np.minimum(range_minima(least, k[again - 1] + 1, k[again]), CAP - 1) + 1
            queue.push(to, new, every[k] - 1, share)
        low = high
    return queue


def _named(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): the substrings from each of ``lms`` to the next one sorted, and where one differs from the one before."""
    size = np.append(np.diff(lms) + 1, 1)
    bits = int(2 * sigma + 1).bit_length()
    pack = max(1, 62 // bits)

    def key(which: np.ndarray, skip: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for x in range(skip, skip + pack):
            at = np.minimum(lms[which] + x, len(text) - 1)
            out = (out << bits) | np.where(x < size[which], 2 * text[at].astype(np.int64) + smaller[at] + 1, 0)
        return out

    first = key(np.arange(len(lms)), 0)
    order = np.argsort(first, kind="stable")
    fresh = np.append(True, first[order[1:]] != first[order[:-1]])
    done = pack
    while True:
        slot = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        slot = slot[size[order[slot]] > done]
        if not len(slot):
            return order, fresh
        which, group = order[slot], np.cumsum(fresh)[slot]
        more = key(which, done)
        by = np.lexsort((more, group))
        order[slot] = which[by]
        group, more = group[by], more[by]
        fresh[slot] = np.append(True, (group[1:] != group[:-1]) | (more[1:] != more[:-1]))
        done += pack


def suffix_array(text: np.ndarray, sigma: int, folder: str, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it) of symbols below sigma, the last being 0 and the only 0.

    Queues go to files in ``folder``.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    step = np.append(text[1:] != text[:-1], True)
    change = np.minimum.accumulate(np.where(step, np.arange(n), n)[::-1])[::-1]  # last place of the run of one symbol
    smaller = np.append(text[:-1] < text[1:], True)[change]
    run = np.minimum(change + 1 - np.arange(n), CAP).astype(np.uint8)
    del step, change
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order, fresh = _named(text, smaller, lms, sigma)
    if fresh.all():
        base, skip, before, after = lms[order], np.zeros(len(lms), np.int64), order[:-1], order[1:]
    else:
        name = np.empty(len(lms), np.int32)
        name[order] = np.cumsum(fresh) - 1
        sub, same = suffix_array(name, int(fresh.sum()), folder, level + 1)
        base, skip = lms[sub], np.zeros(len(lms), np.int64)
        end = np.minimum(sub[:-1] + same[1:].astype(np.int64), len(lms) - 1)
        skip[1:] = np.minimum(lms[end] - lms[sub[:-1]], CAP)
        before, after = end, np.minimum(sub[1:] + same[1:].astype(np.int64), len(lms) - 1)
    lcp = skip
    near = np.flatnonzero(skip[1:] < CAP)
    lcp[1:][near] += alike(text, lms[before[near]], lms[after[near]])
    base_lcp = np.minimum(lcp, CAP).astype(np.uint8)
    del order, fresh, skip, before, after
    up = _induce(text, ~smaller, base.astype(np.int32), base_lcp, run, sigma, folder, f"{level}-up")
    larger, larger_lcp = up.place[: up.first[-1]], up.lcp[: up.first[-1]]
    wanted = smaller.copy()
    wanted[-1] = False  # the end stands before all others and is sent by none
    down = _induce(sigma - 1 - text, wanted, larger[::-1], _backwards(larger_lcp), run, sigma, folder, f"{level}-down")
    less, less_lcp = down.place[: down.first[-1]][::-1], _backwards(down.lcp[: down.first[-1]])
    every = np.concatenate((larger, np.array([n - 1], np.int32), less))
    return _joined(text[every], len(larger), every, np.concatenate((larger_lcp, np.zeros(1, np.uint8), less_lcp)), run)
