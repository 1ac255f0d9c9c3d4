"""Exact top-k inner products by best-first search in M-trees.

Vectors are cut into blocks by the hash of their id, and each block is one M-tree: pages of a router, a
covering radius, and entries with their stored distances to that router. The metric is the Euclidean distance
after one more coordinate has brought all vectors of a block to one length; there a larger inner product is a
smaller distance: d^2 = |q|^2 + M - 2 ip. The search takes the page of the largest bound first. Stored
distances bound an entry by the triangle inequality before its own distance is computed; only what these
bounds leave is computed, and scores are integer dot products. Equal scores are never cut off, so ties go to
the smaller id exactly.

Queries are a stated part of the rows and go to every block; each block answers with k rows a query.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors are compared
with those of their own length only; rows of one id and equal vector are one; rows of the query's own id are
never its candidates. Scores are exact whatever the components: bounds and distances are floating-point with slack,
scores of a block where a sum could leave 64 bits are summed in integers of any size. A component beyond 64 bits,
or a score that a long cannot hold, is refused with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Entries of a page; vectors of a block, on average.
PAGE, BLOCK = 256, 8192
#: Slack for rounding of distances, in units of the squared distance.
SLACK = 1e-6


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors.astype(np.int64)
        norms = (self.v.astype(float) ** 2).sum(axis=1)
        self.longest = float(norms.max(initial=0))
        extra = np.sqrt(np.maximum(self.longest - norms, 0))
        self.widest = np.abs(self.v.astype(float)).max(axis=0, initial=0)
        self.x = np.column_stack([self.v.astype(float), extra]) if len(ids) else np.zeros((0, vectors.shape[1] + 1))
        self.computed = 0
        self.root = self._page(np.arange(len(ids)), np.random.default_rng(7)) if len(ids) else None

    def _to(self, at: np.ndarray, router: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[at] - router) ** 2).sum(axis=1))

    def _page(self, at: np.ndarray, rng) -> dict:
        centre = self.x[at].mean(axis=0)
        router = self.x[at[int(np.argmin(self._to(at, centre)))]]
        d = self._to(at, router)
        page = {"router": router, "radius": float(d.max(initial=0))}
        if len(at) <= PAGE:
            return page | {"points": at, "stored": d}
        seeds = self.x[rng.choice(at, min(PAGE, -(-len(at) // PAGE) + 1), replace=False)]
        near = np.argmin(np.stack([self._to(at, s) for s in seeds]), axis=0)
        parts = [at[near == k] for k in range(len(seeds)) if (near == k).any()]
        if max(map(len, parts)) > 0.9 * len(at):  # many equal vectors
            parts = np.array_split(at[np.argsort(d, kind="stable")], min(PAGE, -(-len(at) // PAGE)))
        children = [self._page(p, rng) for p in parts]
        routers = np.stack([c["router"] for c in children])
        stored = np.sqrt(((routers - router) ** 2).sum(axis=1))
        return page | {"children": children, "routers": routers, "stored": stored, "radii": np.array([c["radius"] for c in children])}

    def top(self, q: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k largest scores, ties to the smaller id, without the id ``but``."""
        if self.root is None:
            return []
        q = q.astype(np.int64)
        x = np.append(q.astype(float), 0.0)
        both = float((q.astype(float) ** 2).sum()) + self.longest
        wide = bool(np.abs(q.astype(float)) @ self.widest >= 2.0**62)  # a sum may leave 64 bits
        slack = SLACK * max(1.0, both)
        best: list[tuple[int, int]] = []
        least = -np.inf
        bound = lambda d: (both - np.maximum(d, 0) ** 2) / 2 + slack  # noqa: E731  the largest score at that distance or farther
        d0 = float(np.sqrt(((self.root["router"] - x) ** 2).sum()))
        queue = [(-float(bound(d0 - self.root["radius"])), 0, d0, self.root)]
        turn = 1
        while queue and -queue[0][0] >= least:
            _, _, d, page = heapq.heappop(queue)
            if "points" in page:
                at = page["points"][bound(np.abs(d - page["stored"])) >= least]
                self.computed += len(at)
                scores = (self.v[at].astype(object) @ q.astype(object)) if wide else self.v[at] @ q
                found = [(s, i) for s, i in zip(scores.tolist(), self.ids[at].tolist()) if s >= least and i != but]
                if found:
                    best = heapq.nsmallest(k, best + found, key=lambda t: (-t[0], t[1]))
                    least = best[-1][0] if len(best) == k else -np.inf
                continue
            open_ = np.flatnonzero(bound(np.abs(d - page["stored"]) - page["radii"]) >= least)
            dist = np.sqrt(((page["routers"][open_] - x) ** 2).sum(axis=1))
            self.computed += len(open_)
            upper = bound(dist - page["radii"][open_])
            for j, dj, u in zip(open_.tolist(), dist.tolist(), upper.tolist()):
                if u >= least:
                    heapq.heappush(queue, (-u, turn, dj, page["children"][j]))
                    turn += 1
        return best


def _search(k: int):
    """Rows (block, query, id, v), sorted by block and query, to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vectors, tree = None, [], [], None
        for batch in batches:
            block, asked, own = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            v = batch.column("v")
            off, flat = v.offsets.to_numpy(), v.values.to_numpy()
            out: list[tuple[int, int, int]] = []
            cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                if block[a] != last:
                    last, ids, vectors, tree = block[a], [], [], None
                rows = flat[off[a] : off[b]].reshape(b - a, -1) if off[b] > off[a] else np.zeros((b - a, 0), np.int64)
                if not asked[a]:
                    ids.append(own[a:b])
                    vectors.append(rows)
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(ids), np.concatenate(vectors)) if ids else MTree(np.zeros(0, np.int64), np.zeros((0, rows.shape[1]), np.int64))
                for i, q in zip(own[a:b].tolist(), rows):
                    out += [(i, vec, score) for score, vec in tree.top(q, k, but=i)]
            if beyond := [s for _, _, s in out if abs(s) >= 1 << 63]:
                raise OverflowError(f"a score of {beyond[0]} is beyond 64 bits")
            q, vec, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, each component floor(256 x); an error where one is beyond 64 bits."""
    x = F.col(vector_col)
    held = lambda c: F.when(F.abs(c) < 2.0**63, F.floor(c)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint"))
    whole = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: held(c.cast("double") * 256)).alias("v")).distinct()


def top_k(points: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, v) queries against all (id, v) points."""
    S.arrow_batches(points.sparkSession)
    blocks = max(1, -(-points.count() // block))
    size = F.size("v")
    stored = points.select(F.xxhash64(size, F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("block"), F.lit(False).alias("query"), "id", "v")
    asked = queries.select("id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("part"))
    asked = asked.select(F.xxhash64(size, F.col("part")).alias("block"), F.lit(True).alias("query"), "id", "v")
    rows = stored.union(asked).repartition("block").sortWithinPartitions("block", "query")
    found = rows.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    points = S.settled(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "mtree-points")
    return top_k(points, points.where("id % 50 = 0"), 5)


OP6_SQL = r"""
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
