"""N-gram Jaccard self-join over count vectors, and the classes of documents that its links connect.

A document is the set of its distinct k-word shingles. Two documents link when ``intersection / union``
is at least ``percent`` / 100. The steps:

1. Documents with the same set are one class. Copies are not compared again.
2. Shingles are ranked by the number of texts that have them, rarest first. Of two linked sets each has a shingle
   of the other among its first ``n - ceil(n * percent / 100) + 1`` (its prefix), so shared prefix shingles are keys;
   shingles of one text alone need none, and a set with more of these than links allow has no partner.
   Texts and shingles meet in packed lists, 7 bytes a shingle. Shingles that stand in ``COMMON`` or more texts of
   one Arrow batch, and those that share a bit of a map of fixed size with them, rank last and are not sent.
3. Classes that share keys form families (each key ties all its members to one of them, within each Arrow
   batch first, so that a key of a third of all rows sends one row a batch). Linked sets are in one family.
4. Each family's texts meet once in a task, where the count vectors of the sets (shingles hashed into ``GROUPS``
   groups, counted) go into an R-tree: the sum of coordinate-wise minima of a vector and a node's upper corner
   bounds the overlap with all below the node. Pairs that pass are verified on the sets. Sets that are
   connected already are passed over, so a task gives fewer links than it has sets, whatever a family's size.
5. A family of more than ``PART_BYTES`` of text is first compared with a few of its members; what these connect
   needs no further comparison within itself. The rest meets in parts.

No pair of linked sets in different components is left uncompared, so the components are exact; no cap is set
on families, keys or partners.

Defined cases: null text or text without words is an empty set, linked with nothing; with fewer words than
k the whole sequence is the one shingle; a null id is reported with a null component; rows that repeat an
id with other texts count as one document whose links pool (``near_classes``) or as rows of their own (``stage``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Coordinates of a count vector: enough that the minima of unlike sets of some thousand shingles stay below what links need.
GROUPS = 256
#: Points of an R-tree leaf, children of an inner node.
FANOUT = 32
#: Texts of one Arrow batch that make a shingle common, bits of the map of common shingles, bits of a packed shingle.
COMMON, MAP_BITS, PACKED = 8, 24, 40
#: Text whose shingles one task ranks; members a large family is first compared with.
RANK_BYTES, HUBS = 12 << 20, 6
#: Text of a family, or of one part of it, that a task holds.
PART_BYTES = 16 << 20
#: Text that one shuffle partition of families holds on average.
TASK_BYTES = 4 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, part, part_off in S.slices(data, off):
        part = S.LOWER[part]
        start, end, first = S.word_bounds(part, part_off, S.IS_TOKEN)
        words = S.word_hashes(part, start, end)
        gram = S.gram_hashes(words, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(gram[a : b - k + 1])
            elif b > a:
                yield S.gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def _digests(k: int):
    """(id, th, bytes, text) to (id, th, bytes, n, d1, d2, common): the set's size, two digests of it, and with a batch's first row the batch's common slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, held = [], [], [], {}
            for th, u in zip(batch.column(1).to_pylist(), shingle_sets(*S.flat(batch.column(3)), k)):
                mixed = S.mix(u ^ _ODD)
                n.append(len(u))
                d1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(S.mix(mixed).sum(dtype=np.uint64).view(np.int64)))
                held[th] = u
            if not n:
                continue
            every = np.sort(np.concatenate(list(held.values())))
            often = every[: len(every) - COMMON + 1][every[: len(every) - COMMON + 1] == every[COMMON - 1 :]] if len(every) >= COMMON else every[:0]
            slots = np.unique(often >> np.uint64(64 - MAP_BITS)).astype(np.int32)
            counts = np.zeros(len(n), np.int64)
            counts[0] = len(slots)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), S.lists(pa.array(slots), counts)], names=["id", "th", "bytes", "n", "d1", "d2", "common"])

    return run


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n in rank order of which any linked set has one."""
    return n + 1 + (n * percent) // -100


_LISTED = "bucket bigint, th array<bigint>, at binary, packed binary"
_RANKED = "th bigint, key bigint, df int"
#: df of a row whose key is what the text's prefix needs beyond the shingles that it lists; df of common shingles.
_NEED, _LAST = 0, (1 << 31) - 1


def _listed(k: int, percent: int, buckets: int, common):
    """(th, text) to _LISTED, a row a batch and bucket: texts, and (text, shingle) packed.

    Buckets below zero have two rows a batch: the texts with how many prefix shingles they need beyond those that they
    list, and with common shingles, which are listed only where a set's other shingles do not fill its prefix.
    """
    low = np.uint64((1 << PACKED) - 1)

    def rows(bucket, th, at, key):
        inside, place = np.unique(at, return_inverse=True)
        packed = key.astype("<u8").view(np.uint8).reshape(-1, 8)
        packed = packed[:, : PACKED // 8] if bucket >= 0 else packed
        return bucket, th[inside], place.astype("<u2").tobytes(), np.ascontiguousarray(packed).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(common.value, np.uint8)
        for batch in batches:  # of at most 2,000 rows
            th, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            sets = list(shingle_sets(*S.flat(batch.column(1).take(pa.array(first))), k))
            if not sum(map(len, sets)):
                continue
            n = np.array([len(u) for u in sets], np.int64)
            u, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            slot = (u >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            often = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            rare, of = u[~often], at[~often]
            key = ((rare >> np.uint64(PACKED)) % np.uint64(buckets) << np.uint64(PACKED)) | (rare & low)
            order = np.argsort(key, kind="stable")
            key, of = key[order], of[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))[: len(key)]
            key, of = key[new], of[new]
            need = prefix(n, percent) - np.bincount(of, minlength=len(n))
            bucket = (key >> np.uint64(PACKED)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [rows(g, th, of[a:b], key[a:b]) for g, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
            some = np.flatnonzero(n)
            spread = int(th[0]) % buckets
            out.append(rows(-1 - 2 * spread, th, some, need[some].astype(np.uint64)))
            more, of = u[often], at[often]
            if len(more):
                turn = np.arange(len(of)) - np.searchsorted(of, of)
                taken = turn < need[of]
                if taken.any():
                    out.append(rows(-2 - 2 * spread, th, of[taken], more[taken]))
            g, names, places, packed = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), S.lists(pa.array(np.concatenate(names)), np.array([len(x) for x in names])), pa.array(places, pa.binary()), pa.array(packed, pa.binary())], names=["bucket", "th", "at", "packed"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LISTED sorted by bucket to _RANKED: a text's shingle that other texts have too, and how many texts have it."""
    for (bucket,), held in _runs(batches, ["bucket"]):
        t = pa.Table.from_batches(held)
        th = np.concatenate([c.flatten().to_numpy() for c in t.column("th").chunks])
        spread = np.concatenate([np.diff(c.offsets.to_numpy()) for c in t.column("th").chunks])
        places = t.column("at").to_pylist()
        name = th[np.frombuffer(b"".join(places), "<u2").astype(np.int64) + np.repeat(np.cumsum(spread) - spread, [len(x) // 2 for x in places])]
        raw = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint8)
        held = t = places = None
        if bucket < 0:
            key, df = raw.view("<i8").astype(np.int64), np.full(len(name), _NEED if bucket % 2 else _LAST)
        else:
            wide = np.zeros((len(name), 8), np.uint8)
            wide[:, : PACKED // 8] = raw.reshape(len(name), -1)
            key = wide.view("<u8").ravel()
            order = np.argsort(key, kind="stable")
            key, name = key[order], name[order]
            same = key[1:] == key[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, name = key[several], name[several]
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))[: len(key)]  # a text in several batches counts once
            key, name = key[once], name[once]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            size = np.diff(np.append(start, len(key)))
            df = np.repeat(size, size)
            key, name, df = S.signed(key[df > 1] | np.uint64(bucket << PACKED)), name[df > 1], df[df > 1]
        for a in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(name[a : a + (1 << 17)], pa.int64()), pa.array(key[a : a + (1 << 17)], pa.int64()), pa.array(df[a : a + (1 << 17)].astype(np.int32))], names=["th", "key", "df"])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Whole runs of rows equal in some number columns."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in names])
        cut = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, batch.num_rows]):
            own = tuple(at[:, i].tolist())
            if held and own != last:
                yield last, held
                held = []
            held.append(batch.slice(i, j - i))
            last = own
    if held:
        yield last, held


def _first_of_runs(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place of its run."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _local_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _RANKED sorted by th to (at, th, hub) of prefix keys.

    hub is the smallest th of a key among some thousand texts, and at spreads the row; for that th itself hub is null, and at is the key.
    """

    def rows(names: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
        ids, key = np.repeat(np.array(names, np.int64), [len(x) for x in own]), np.concatenate(own)
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        hub = ids[_first_of_runs(key)]
        first = hub == ids
        return pa.RecordBatch.from_arrays([pa.array(np.where(first, key, ids)), pa.array(ids), pa.array(hub, mask=first)], names=["at", "th", "hub"])

    names, own = [], []
    for (th,), held in _runs(batches, ["th"]):
        keys, df = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "df"))
        need = keys[df == _NEED][0]
        keys, one = np.unique(keys[df != _NEED], return_index=True)
        df = df[df != _NEED][one]
        q = int(need) + int((df < _LAST).sum())
        if q > 0:
            names.append(th)
            own.append(keys[np.lexsort((keys, df))[:q]])
        if len(names) == 4000:
            yield rows(names, own)
            names, own = [], []
    if names:
        yield rows(names, own)


def _run_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, th, hub) sorted by at and th, to (hub, th): of rows without a hub the first of each run is the hub of the others."""
    last_key, last_hub = None, None
    for batch in batches:
        known = ~batch.column(2).is_null().to_numpy(zero_copy_only=False)
        key, ids = (batch.column(c).to_numpy()[~known] for c in (0, 1))
        hub = ids
        if len(key):
            hub = ids[_first_of_runs(key)].copy()
            if last_key is not None and key[0] == last_key:
                hub[: np.searchsorted(key, last_key, side="right")] = last_hub
            last_key, last_hub = key[-1], hub[-1]
        at = pa.array(np.flatnonzero(known))
        a = np.concatenate([hub[hub != ids], batch.column(2).take(at).to_numpy()])
        b = np.concatenate([ids[hub != ids], batch.column(1).take(at).to_numpy()])
        if len(a):
            both = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["hub", "th"])


def may_link(overlap, na, nb, percent: int):
    """Whether an overlap (bound) lets two sets of these sizes link: 100 I >= p (na + nb - I)."""
    return (100 + percent) * overlap >= percent * (na + nb)


class CountRTree:
    """Count vectors in pages; a node keeps the upper corner and the sizes' range. ``order``: the points as they lie in the leaves."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((vec[:, int(np.argmax(vec.var(axis=0)))], n)) if len(n) else np.zeros(0, np.int64)
        level = (vec[self.order], n[self.order], n[self.order])
        self.levels = [level]
        while len(level[1]) > FANOUT:
            at = np.arange(0, len(level[1]), FANOUT)
            level = (np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at))
            self.levels.append(level)

    def near(self, vec: np.ndarray, n: int, percent: int, open_: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        """Leaf places of the points, among those that open_ marks, whose overlap bound lets them link with a set."""
        top = len(self.levels) - 1
        stack, out = [(top, np.arange(len(self.levels[top][1])))], []
        while stack:
            at, node = stack.pop()
            hi, n0, n1 = self.levels[at]
            if at == 0:
                node = node[open_[node]]
            node = node[(100 * n >= percent * n0[node]) & (100 * n1[node] >= percent * n)]
            node = node[may_link(np.minimum(vec, hi[node]).sum(axis=1, dtype=np.int64), n, n0[node], percent)]
            if not len(node):
                continue
            if at == 0:
                out.append(node)
                continue
            below = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < len(self.levels[at - 1][1])]
            stack += [(at - 1, below[a : a + step]) for a in range(0, len(below), step)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    row = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    slot = (np.concatenate(sets) & np.uint64(GROUPS - 1)).astype(np.int64) if sets else row
    return np.bincount(row * GROUPS + slot, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def linked(sets: list[np.ndarray], comp: np.ndarray, asks: np.ndarray, answers: np.ndarray, percent: int, step: int = 512) -> list[tuple[int, int]]:
    """Links (places of two sets) that connect all that links between asking and answering sets connect, beyond what comp does."""
    n = np.array([len(u) for u in sets], np.int64)
    vec, comp = count_vectors(sets), comp.copy()
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate(([0], np.cumsum(n)))
    points = np.flatnonzero(answers)
    tree = CountRTree(vec[points], n[points])
    leaf = points[tree.order]  # the set of each leaf place
    lies = np.full(len(sets), -1)
    lies[leaf] = np.arange(len(leaf))
    queries = np.flatnonzero(asks)
    queries = queries[np.argsort(lies[queries], kind="stable")]
    in_q, links = np.zeros(len(words), bool), []
    for q in queries.tolist():
        open_ = comp[leaf] != comp[q]
        if lies[q] >= 0:
            open_[: lies[q]] &= ~asks[leaf[: lies[q]]]  # those have asked before
        if not open_.any():
            continue
        found = leaf[tree.near(vec[q], int(n[q]), percent, open_)]
        if not len(found):
            continue
        in_q[place[off[q] : off[q + 1]]] = True
        for a in range(0, len(found), step):
            p = found[a : a + step]
            p = p[comp[p] != comp[q]]
            if not len(p):
                continue
            hit = in_q[np.concatenate([place[off[i] : off[i + 1]] for i in p.tolist()])]
            both = np.add.reduceat(hit, np.cumsum(n[p]) - n[p], dtype=np.int64)
            p = p[may_link(both, n[q], n[p], percent)]
            _, one = np.unique(comp[p], return_index=True)
            for i in p[one].tolist():
                links.append((q, i))
                comp[comp == comp[i]] = comp[q]
        in_q[place[off[q] : off[q + 1]]] = False
    return links


_TEXTS = "fam bigint, one bigint, two bigint, side int, cls bigint, comp bigint, text string"


def _family_links(k: int, percent: int):
    """Rows of _TEXTS sorted by (fam, one, two) to links (a, b). side: 0 asks, 1 answers, 2 both."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        cls, first = np.unique(t.column("cls").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        sets = list(shingle_sets(*S.flat(t.column("text")), k))
        found = linked(sets, comp, side != 1, side != 0, percent) if len(cls) > 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(cls[list(a)], pa.int64()), pa.array(cls[list(b)], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _runs(batches, ["fam", "one", "two"]):
            yield links(held)

    return run


def _once_a_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _TEXTS without those whose cls came before in the same batch and part: copies of one row."""
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("cls", "one", "two")])
        yield batch.take(pa.array(np.sort(np.unique(at, axis=1, return_index=True)[1])))


def _verify(k: int, percent: int):
    """(a, b, ta, tb) to the (a, b) whose texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(shingle_sets(*S.flat(batch.column(2)), k), shingle_sets(*S.flat(batch.column(3)), k))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and may_link(both, len(x), len(y), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ids that links (a, b) have; comp is the smallest id that they reach.

    Each round ties every id to the neighbour (or itself) of the least hash, and that one's own choice; what is
    tied together becomes one point of the next round's smaller graph. Every round is a written table.
    """
    spark = links.sparkSession
    edges = S.settled(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        chosen = S.settled(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", ranked("a"))["id"].alias("to")), "links-chosen")
        further = chosen.select(F.col("id").alias("to"), F.col("to").alias("root"))
        tied = S.settled(chosen.join(further, "to").select("id", F.col("root").alias("to")), "links-tied")
        side = lambda c: tied.select(F.col("id").alias(c), F.col("to").alias("to_" + c))
        left = edges.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        smaller = S.settled(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        S.discard(spark, edges, chosen)
        edges = smaller
        rounds.append(tied)
    S.discard(spark, edges)
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0)
    group = rounds[-1]
    for tied in reversed(rounds[:-1]):
        group = tied.join(group.select(F.col("id").alias("to"), F.col("to").alias("root")), "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    group = S.settled(group, "components")
    S.discard(spark, *rounds)
    return group.join(group.groupBy("to").agg(F.min("id").alias("comp")), "to").select("id", "comp")


def _large_links(texts: DataFrame, k: int, percent: int, part_bytes: int) -> DataFrame:
    """Links within families of more than part_bytes. texts: (fam, cls, bytes, text), settled."""
    spark = texts.sparkSession
    rows = texts.select("fam", "cls", "bytes")
    links = spark.createDataFrame([], "a bigint, b bigint")

    def state() -> DataFrame:
        return rows.join(components(links).withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    for turn in range(HUBS):
        now = S.settled(state(), "jaccard-state")
        hub = now.groupBy("fam").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("cls", F.lit(turn))).alias("h")).select("fam", F.col("h.cls").alias("b"), F.col("h.comp").alias("hub_comp"))
        hub = hub.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        left = now.join(hub, "fam").where("comp <> hub_comp").select("cls", "b", "tb").join(texts.select("cls", "text"), "cls")
        found = left.select(F.col("cls").alias("a"), "b", F.col("text").alias("ta"), "tb").mapInArrow(_verify(k, percent), "a bigint, b bigint")
        links = S.settled(links.union(found), "jaccard-links")
        S.discard(spark, now)
    now = S.settled(state(), "jaccard-state")
    whole = now.groupBy("fam", "comp").agg(F.sum("bytes").alias("size")).withColumn("solid", F.col("size") > part_bytes)
    loose = whole.where("not solid").groupBy("fam").agg(F.ceil(F.sum("size") / part_bytes).alias("loose"))
    spread = now.join(whole, ["fam", "comp"]).join(loose, "fam", "left")
    of_comp = F.xxhash64("comp", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / part_bytes)))
    spread = S.settled(spread.select("fam", "cls", "comp", "solid", F.when(F.col("solid"), of_comp).otherwise(F.pmod(F.xxhash64("comp"), F.col("loose"))).alias("part")), "jaccard-parts")
    # Parts of one component of its own are not compared with each other. A row a part, some megabytes of text each.
    parts = spread.select("fam", "part", F.when(F.col("solid"), F.col("comp")).alias("only")).distinct()
    other = parts.select("fam", F.col("part").alias("two"), F.col("only").alias("only2"))
    pairs = parts.select("fam", F.col("part").alias("one"), "only").join(other, "fam").where("one <= two and (only is null or only2 is null or only <> only2)").select("fam", "one", "two")
    asks = spread.withColumn("one", F.col("part")).join(pairs, ["fam", "one"]).withColumn("side", F.when(F.col("one") == F.col("two"), 2).otherwise(0))
    answers = spread.withColumn("two", F.col("part")).join(pairs.where("one <> two"), ["fam", "two"]).withColumn("side", F.lit(1))
    cols = ["fam", "one", "two", "side", "cls", "comp"]
    met = asks.select(cols).union(answers.select(cols)).join(texts.select("cls", "text"), "cls").select(*cols, "text")
    size = (rows.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES
    more = met.repartition(_tasks(spark, size), "fam", "one", "two").sortWithinPartitions("fam", "one", "two").mapInArrow(S.trimmed(_family_links(k, percent)), "a bigint, b bigint")
    return links.union(S.settled(more, "jaccard-more"))


def _tasks(spark, tasks: int) -> int:
    return int(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def set_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): (id, th, n, cls) for every row, th a hash of its text, cls null for null ids and empty
    sets; (cls, id, th), the row of the smallest id that stands for a class; links (a, b) of classes that connect all that link."""
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=4)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), text.alias("text"))
    sigs = S.settled(source.mapInArrow(S.trimmed(_digests(k)), "id bigint, th bigint, bytes bigint, n bigint, d1 bigint, d2 bigint, common array<int>"), "jaccard-digests")
    stands = sigs.where("id is not null and n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "th", "bytes")).alias("f"))
    # Numbers are given as the table is written and read from it ever after.
    classes = S.settled(stands.select("n", "d1", "d2", "f.*", F.monotonically_increasing_id().alias("cls")), "jaccard-classes")
    rows = sigs.join(classes.select("n", "d1", "d2", "cls"), ["n", "d1", "d2"], "left")
    rows = S.settled(rows.select("id", "th", "n", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")), "jaccard-rows")
    # At most 2^MAP_BITS numbers come to the driver, and one bit of each goes to all machines.
    slots = np.array([r[0] for r in sigs.where(F.size("common") > 0).select(F.explode("common").alias("s")).distinct().toLocalIterator()], np.int64)
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    buckets = int(-(-(sigs.agg(F.sum("bytes")).first()[0] or 1) // RANK_BYTES))
    named = source.where("id is not null").select("th", "text")
    lists = named.mapInArrow(S.trimmed(_listed(k, percent, buckets, spark.sparkContext.broadcast(bits.tobytes()))), _LISTED)
    ranked = lists.repartition(_tasks(spark, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(S.trimmed(_ranked), _RANKED)
    local = ranked.repartition(_tasks(spark, buckets), "th").sortWithinPartitions("th").mapInArrow(_local_hubs, "at bigint, th bigint, hub bigint")
    star = local.repartition("at").sortWithinPartitions("at", "th").mapInArrow(_run_hubs, "hub bigint, th bigint").distinct()
    star = S.settled(star, "jaccard-star")
    del lists, ranked, local
    S.discard(spark, sigs)
    of_text = rows.where("cls is not null").select("th", "cls").distinct()
    edges = star.join(of_text.select(F.col("th").alias("hub"), F.col("cls").alias("a")), "hub").join(of_text.withColumnRenamed("cls", "b"), "th").where("a <> b").select("a", "b")
    family = components(edges)
    S.discard(spark, star)
    members = S.settled(family.select(F.col("id").alias("cls"), F.col("comp").alias("fam")).join(classes.select("cls", "id", "th", "bytes"), "cls"), "jaccard-members")
    size = members.groupBy("fam").agg(F.sum("bytes").alias("size"))
    large = size.where(F.col("size") > part_bytes).select("fam")
    zero = F.lit(0).cast("bigint")
    small = source.drop("bytes").hint("merge").join(members.join(large, "fam", "left_anti"), ["id", "th"])
    small = small.select("fam", zero.alias("one"), zero.alias("two"), F.lit(2).alias("side"), "cls", F.col("cls").alias("comp"), "text").mapInArrow(_once_a_batch, _TEXTS)
    tasks = (members.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES
    small = small.repartition(_tasks(spark, tasks), "fam").sortWithinPartitions("fam").mapInArrow(S.trimmed(_family_links(k, percent)), "a bigint, b bigint")
    links = S.settled(small, "jaccard-links")
    if not large.isEmpty():
        texts = source.drop("bytes").hint("merge").join(members.join(large, "fam"), ["id", "th"]).select("fam", zero.alias("one"), zero.alias("two"), F.lit(2).alias("side"), "cls", F.col("bytes").alias("comp"), "text")
        texts = texts.mapInArrow(_once_a_batch, _TEXTS).groupBy("fam", "cls", F.col("comp").alias("bytes")).agg(F.any_value("text").alias("text"))
        links = links.union(_large_links(S.settled(texts, "jaccard-texts"), k, percent, part_bytes))
    S.discard(spark, members)
    return rows, classes.select("cls", "id", "th"), links


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, n, comp) for every row, comp the smallest id that links reach; and the links (a, b) by their classes' smallest ids."""
    rows, classes, links = set_classes(docs, id_col=id_col, text_col=text_col, k=k, percent=percent, part_bytes=part_bytes)
    named = rows.where("cls is not null")
    several = named.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("id", "a")
    pooled = links.union(named.join(several, "id").where("a <> cls").select("a", F.col("cls").alias("b")))
    comp = components(pooled).withColumnRenamed("id", "cls")
    of_class = classes.join(comp, "cls", "left").select("cls", "id", F.coalesce("comp", "cls").alias("group"))
    least = of_class.groupBy("group").agg(F.min("id").alias("comp"))
    of_class = of_class.join(least, "group").select("cls", "comp")
    out = rows.join(of_class, "cls", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    name = lambda c: classes.select(F.col("cls").alias(c), F.col("id").alias("id_" + c))
    return out, links.join(name("a"), "a").join(name("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def op8(spark, sf_dir: str) -> DataFrame:
    rows, _ = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at 0.8 connect stays: the row of the smallest id.

    Rows of null id and rows without words stay, all of them. Of rows that are equal in id and text one stays. Rows that
    repeat an id with another text are rows of their own: they stay unless their text links with one that stays.
    """
    rows, classes, links = set_classes(docs)
    comp = components(links).withColumnRenamed("id", "cls")
    stays = classes.join(comp, "cls", "left").groupBy(F.coalesce("comp", "cls").alias("group")).agg(F.min(F.struct("id", "th")).alias("f")).select("f.*")
    each = rows.where("cls is not null").groupBy("id", "th").agg(F.count("*").alias("times"))
    each = S.settled(each, "jaccard-each")
    gone = each.join(stays, ["id", "th"], "left_anti").union(each.where("times > 1").join(stays, ["id", "th"], "left_semi")).select("id", "th")
    gone = S.settled(gone, "jaccard-gone")
    th = F.xxhash64(docs["text"].cast("string"))
    of = lambda t: (docs["doc_id"].cast("bigint") == t["id"]) & (th == t["th"])
    # Both sides grow with the texts: neither is broadcast.
    single = docs.join(gone.hint("merge"), of(gone), "left_anti")
    if each.where("times > 1").isEmpty():
        return single
    again = S.settled(each.where("times > 1").join(stays, ["id", "th"], "left_semi").select("id", "th"), "jaccard-again")
    return single.union(docs.join(again, of(again), "left_semi").dropDuplicates(["doc_id", "text"]))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) END) AS s FROM w),
h AS MATERIALIZED (SELECT doc_id, s, hash(s) AS h FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.h = b.h AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) m USING (doc_id)
"""
