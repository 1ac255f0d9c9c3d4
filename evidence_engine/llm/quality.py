"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees over the statistics of a bounded sample of labelled rows give paths; every path from a
root is a rule, a conjunction of comparisons. A logistic model with an L1 penalty weighs the rules, most get
weight zero, and the rest are compiled into one Spark column expression over the statistics' columns. The
statistics come from one pass over the whole texts in Arrow batches.

Defined cases: null text counts as empty, whose statistics are all zero and which gets a score as any other;
rows that repeat get the same score; without usable labels every score is 0.5, with one class only its rate
(smoothed by one row of each class). Columns of the documents keep their names; statistics are ``__q_*``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared as S

#: Labelled rows, those of the least hash of their id, that a model is fitted on at most.
SAMPLE_ROWS = 20_000
PREFIX = "__q_"

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[S.SPACES] = 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_MARKS = np.frombuffer(b"!#$%&*|", np.uint8)

STATS = [
    "words", "word_bytes", "lower", "upper", "digit", "punctuation", "beyond", "other", "marks", "words_a_line",
    "distinct", "repeated_lines", "long_words", "one_byte_words", "ends_marked", "capital_words", "most_common",
]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    out = [_part(part, part_off) for _, _, part, part_off in S.slices(data, off)]
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def _part(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    x = np.zeros((rows, len(STATS)))
    size = np.diff(off)
    total = np.maximum(size, 1)
    kind = _CLASS[data]
    per_row = lambda flags: (c := np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))[off[1:]] - c[off[:-1]]
    start, end, first = S.word_bounds(data, off, S.IS_TOKEN)
    n = np.diff(first)
    per = np.maximum(n, 1)
    of_words = lambda flags: (c := np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))[first[1:]] - c[first[:-1]]
    length = end - start
    letters = np.maximum(per_row(kind == 1) + per_row(kind == 2) + per_row(kind == 6), 1)
    lines = per_row(data == 10) + 1
    x[:, 0] = np.log1p(n)
    x[:, 1] = of_words(length) / per
    for k, c in zip(range(2, 8), (1, 2, 3, 5, 6, 0)):
        x[:, k] = per_row(kind == c) / (letters if c in (1, 2, 6) else total)
    x[:, 8] = per_row(np.isin(data, _MARKS)) / total
    x[:, 9] = np.log1p(n / lines)
    x[:, 12] = of_words(length > 14) / per
    x[:, 13] = of_words(length == 1) / per
    if len(start):
        x[:, 14] = of_words(np.isin(data[end - 1], _MARKS)) / per
        x[:, 15] = of_words(kind[start] == 2) / per
    hashes = S.word_hashes(S.LOWER[data], start, end)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            counts = np.unique(hashes[a:b], return_counts=True)[1]
            x[i, 10] = len(counts) / (b - a)
            x[i, 16] = counts.max() / (b - a)
    raw = data.tobytes()
    for i in np.flatnonzero(lines > 1).tolist():
        own = [y for y in raw[off[i] : off[i + 1]].split(b"\n") if y]
        x[i, 11] = 1 - len(set(own)) / len(own) if own else 0
    return x


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and STATS, under PREFIX, of the whole texts."""
    S.arrow_batches(df.sparkSession, mb=4)
    schema = T.StructType([*df.schema.fields, *(T.StructField(PREFIX + s, T.DoubleType()) for s in STATS)])
    at = df.columns.index(text_col)
    names = [*df.columns, *(PREFIX + s for s in STATS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*S.flat(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(STATS)))], names=names)

    return df.mapInArrow(S.trimmed(run), schema)


Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """rule: (statistic, whether it must be above, limit), all of which must hold."""
    return reduce(np.logical_and, (x[:, j] > c if above else x[:, j] <= c for j, above, c in rule))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20) -> list[Rule]:
    """Rules of all nodes, but the root, of boosted trees fitted to the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    margin = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        open_ = [((), np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for rule, at in open_:
                G, H = g[at].sum(), h[at].sum()
                best = (1e-6, None, None)
                if level < depth and len(at) >= 2 * least:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[j][at]
                        gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                        gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                        gain[(ns < least) | (len(at) - ns < least)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] is None:
                    margin[at] += rate * G / (H + 1)
                    continue
                _, j, k = best
                below = binned[j][at] <= k
                for above, part in ((False, at[below]), (True, at[~below])):
                    following.append(((*rule, (j, above, float(cuts[j][k]))), part))
                    rules[tuple(sorted(following[-1][0]))] = None
            open_ = following
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights, by accelerated proximal gradient steps."""
    n, k = r.shape
    rate = 4.0 / max(1e-9, np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2 / n)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(v[0] + r @ v[1:], -30, 30))) - y
        new = v - rate * np.concatenate(([d.mean()], r.T @ d / n))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules of nonzero weight."""
    ones = float(y.sum())
    if not len(y) or ones in (0.0, float(len(y))):
        rate = (ones + 1) / (len(y) + 2)
        return float(np.log(rate / (1 - rate))), []
    rules = tree_rules(x, y)
    if not rules:
        return float(np.log(ones / (len(y) - ones))), []
    r = np.column_stack([holds(rule, x) for rule in rules]).astype(float)
    intercept, w = lasso_logistic(r, y, penalty)
    return intercept, [(float(a), rule) for a, rule in zip(w, rules) if a != 0]


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The model as one column expression over the statistics."""
    total = F.lit(intercept)
    for weight, rule in rules:
        tests = (F.col(PREFIX + STATS[j]) > c if above else F.col(PREFIX + STATS[j]) <= c for j, above, c in rule)
        total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents that are not held out, those of the least hash.

    Labels that are null, or whose rows for an id disagree half and half, teach nothing.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y")).where("y <> 0.5")
    y = y.where(S.crc_mod(F.col("doc_id"), 4) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    y = F.broadcast(y.select(F.col("doc_id").alias("id"), (F.col("y") > 0.5).cast("int").alias("y")))  # at most ``rows`` rows of two numbers
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(y, "id")


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[float, list[tuple[float, Rule]]]:
    sample = with_statistics(labelled_sample(docs, labels, label, rows)).drop("text").orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()
    return fit(sample[[PREFIX + s for s in STATS]].to_numpy(float), sample["y"].to_numpy(float))


def scored(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]], score: str = "score") -> DataFrame:
    """The documents' columns and their score."""
    return with_statistics(docs).withColumn(score, compiled(*model)).drop(*(PREFIX + s for s in STATS))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return rows.select("doc_id", (S.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is at least 0.7."""
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, "__q_score").where("__q_score >= 0.7").drop("__q_score")
