"""Mixing sources to target weights in fixed-length blocks of words.

Each source's documents, laid end to end in a fixed order, are cut into blocks of ``block_words`` words. A
source's target is its share of all words by weight, at most ``most`` times its size, the excess shared by
weight among the others. The mix is written in output shards of about ``shard_words`` words. For each shard
the number of blocks of each source is drawn: the whole part of what its target gives a shard, and a
multinomial draw, by the fractions that are left, of the rest. (A draw of all would leave a source of a
hundred blocks a tenth off its target; this leaves it a block or two a shard at most.) The counts drawn
are the slots: those of a source are numbered through all shards, and slot k takes block
perm(k mod blocks), where perm is a keyed permutation of the source's block numbers (a Feistel network,
walked until it falls inside). Slots beyond ``most`` passes are not filled. So no block is taken more often than
``most`` times, passes differ from each other by at most one, and slots and blocks meet in an equi-join on
(source, block).

Order, draws and permutations come from hashes and seeds of the rows alone: reruns agree.

Defined cases: null text has size 0; null is a source of its own, after all others; documents of size 0 are
taken 0 times; rows that repeat are mixed as separate rows; without any words all targets are 0; columns of
the documents that are named as those of the result are left out of it. Sources are ranked, shared out and
drawn by lists of a row a source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Words of a block; rows of a source's bucket in which running positions are summed; words of an output shard.
BLOCK_WORDS, BUCKET_ROWS, SHARD_WORDS = 64, 500, 1 << 20
#: Slots that one task makes on average; sources up to which a row for each is sent to all machines.
TASK_SLOTS, BROADCAST_SOURCES = 1 << 17, 20_000
ADDED = ["row_hash", "row_check", "skey", "size", "bucket", "own", "base", "start", "source_size", "target"]
WEIGHTS, MOST = (5, 2, 1), 3
SIZE = r"[^\x20\x09-\x0D]+"


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, at the places k."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(6):
            left, right = right, left ^ (S.mix(right + np.uint64((key * 8 + r) & 0xFFFFFFFFFFFF)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size): shares by weight, capped, the excess reshared.

    Sources in order of the level at which they reach their cap; the first source that the level of those
    from it on does not lift to its cap sets the level of all.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy(F.lit(1))) - F.col("capped")) / F.col("open"))
    holds = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("capped").alias("c"), F.col("level").alias("v")))
    s = s.withColumn("v", F.coalesce(F.min(holds).over(Window.partitionBy(F.lit(1)))["v"], F.lit(0.0)))
    return s.select("skey", "source_size", F.least("cap", F.col("v") * F.col("w")).alias("target"))


def source_key(source):
    """Sorts as the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def drawn(expected: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts near those expected: whole parts, and a multinomial draw of the rest by the fractions."""
    whole = np.floor(expected)
    rest = expected - whole
    left = float(rest.sum())
    n = int(left) + int(rng.random() < left - int(left))
    return (whole + (rng.multinomial(n, rest / left) if n else 0)).astype(np.int64)


def _shard_counts(shards: int, seed: int):
    """(shard, sources: list of (skey, blocks, slots)) to (shard, skey, blocks, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sources in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = drawn(np.array([s["slots"] for s in sources]) / shards, np.random.default_rng([seed, shard]))
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array([sources[i]["skey"] for i in at], pa.string()), pa.array([sources[i]["blocks"] for i in at], pa.int64()), pa.array(counts[at])], names=["shard", "skey", "blocks", "slots"])

    return run


def _slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for skey, blocks, shard, first, slots in zip(*(batch.column(c).to_pylist() for c in ("skey", "blocks", "shard", "first", "slots"))):
                key = zlib.crc32(skey.encode()) * 31 + seed
                for a in range(first, first + slots, 1 << 16):
                    k = np.arange(a, min(a + (1 << 16), first + slots))
                    block = permuted(k % blocks, blocks, key)
                    yield pa.RecordBatch.from_arrays([pa.array([skey]).take(pa.array(np.zeros(len(k), np.int64))), pa.array(block), pa.array(np.full(len(k), shard)), pa.array(k)], names=["skey", "block", "shard", "slot"])

    return run


def mixed(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, bucket_rows: int = BUCKET_ROWS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, spans, slots, counts).

    documents: the given columns but the text, and row_hash, row_check, skey, size, source_size, target, start;
    spans: (skey, block, start, lo, hi): which words of the document at ``start`` lie in a block, as positions
    in the source; slots: (skey, block, shard, slot): the mix, block by block; counts: (shard, skey, blocks, slots):
    the blocks drawn for each shard.
    """
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=4)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SIZE)), F.lit(0)).cast("bigint")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in ADDED]
    base = S.settled(docs.select(*kept, F.xxhash64(*docs.columns).alias("row_hash"), F.hash(*docs.columns).alias("row_check"), size.alias("size"), source_key(F.col(source_col)).alias("skey")), "mix-sizes")
    shares = S.settled(targets(base.groupBy("skey").agg(F.sum("size").alias("source_size"))), "mix-targets")
    rows = base.groupBy("skey").agg(F.ceil(F.count("*") / bucket_rows).alias("buckets"))
    few = F.broadcast if shares.count() <= BROADCAST_SOURCES else lambda t: t
    own = base.join(few(rows), "skey").withColumn("bucket", F.pmod(F.col("row_hash"), F.col("buckets"))).drop("buckets")
    sums = own.groupBy("skey", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "bucket").orderBy("row_hash", "row_check").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["skey", "bucket"])
    placed = placed.withColumn("start", F.col("base") + F.col("own")).drop("bucket", "base", "own").join(few(shares), "skey")
    placed = S.settled(placed, "mix-documents")
    b = F.lit(block_words)
    spans = placed.where("size > 0").select("skey", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
    spans = spans.select("skey", "block", "start", F.greatest("start", F.col("block") * b).alias("lo"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b).alias("hi"))
    blocks = F.ceil(F.col("source_size") / b).cast("bigint")
    plan = shares.where("source_size > 0").select("skey", blocks.alias("blocks"), (F.col("target") / F.col("source_size") * blocks).alias("slots"))
    words = shares.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    sources = plan.agg(F.sort_array(F.collect_list(F.struct("skey", "blocks", "slots"))).alias("sources"))  # one row, an entry a source
    wanted = spark.range(shards, numPartitions=min(shards, max(tasks, -(-shards // 64)))).select(F.col("id").alias("shard")).crossJoin(F.broadcast(sources))
    counts = S.settled(wanted.mapInArrow(_shard_counts(shards, seed), "shard bigint, skey string, blocks bigint, slots bigint"), "mix-counts")
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = counts.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    dealt = dealt.withColumn("slots", F.least("slots", F.col("blocks") * MOST - F.col("first"))).where("slots > 0").select("skey", "blocks", "shard", "first", "slots")
    slots = dealt.repartition(max(tasks, words // block_words // TASK_SLOTS), "skey", "shard").mapInArrow(_slots(seed), "skey string, block bigint, shard bigint, slot bigint")
    return placed, spans, slots, counts


def takes(spans: DataFrame, slots: DataFrame) -> DataFrame:
    """The spans that are taken, and how many times. Both sides grow with the texts: neither is broadcast, however well it compresses."""
    return spans.hint("merge").join(slots.groupBy("skey", "block").agg(F.count("*").alias("times")), ["skey", "block"])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    placed, spans, slots, _ = mixed(docs)
    taken = takes(spans, slots).groupBy("skey", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    hit = placed.where("size > 0").hint("merge").join(taken.hint("merge"), ["skey", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return hit.union(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def _cut(text_at: int, chars_at: int | None, columns: int):
    """Rows of documents' columns and ``spans`` to one row for each pass: the words that it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            rows, out = [], []
            for i, spans in enumerate(batch.column(columns).to_pylist()):
                raw = (texts[i] or "").encode()
                start, end, _ = S.word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), S.IS_TOKEN)
                for copy in sorted({s["start"] for s in spans}):
                    own = sorted((s["lo"] - copy, s["hi"] - copy, s["times"]) for s in spans if s["start"] == copy)
                    for turn in range(1, max(t for _, _, t in own) + 1):
                        joined: list[list[int]] = []
                        for lo, hi, times in own:
                            if times < turn:
                                continue
                            if joined and joined[-1][1] == lo:
                                joined[-1][1] = hi
                            else:
                                joined.append([lo, hi])
                        whole = joined == [[0, len(start)]]
                        rows.append(i)
                        out.append(texts[i] if whole else "\n".join(raw[start[lo] : end[hi - 1]].decode() for lo, hi in joined))
            at = pa.array(rows, pa.int64())
            cols = [c.take(at) for c in batch.columns[:columns]]
            cols[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([len(x) for x in out], cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:columns])

    return run


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: for each pass over a document that takes any of its words, one row with those words.

    A pass that takes all words keeps the text as it is. Documents without words (null or empty texts) have nothing to take;
    rows that repeat have each their own words taken; an empty table gives an empty mix.
    """
    placed, spans, slots, _ = mixed(docs)
    row = ["row_hash", "row_check"]
    own = takes(spans, slots).join(placed.where("size > 0").select("skey", "start", *row).hint("merge"), ["skey", "start"])
    per_row = own.groupBy(*row).agg(F.collect_list(F.struct("start", "lo", "hi", "times")).alias("__spans"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    keyed = docs.select(F.xxhash64(*docs.columns).alias("row_hash"), F.hash(*docs.columns).alias("row_check"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    joined = keyed.dropDuplicates(row).join(per_row, row).select(*names, "__spans").withColumnsRenamed(dict(zip(names, docs.columns)))
    at = docs.columns.index("text")
    return joined.mapInArrow(S.trimmed(_cut(at, docs.columns.index("n_chars") if "n_chars" in docs.columns else None, len(docs.columns))), docs.schema)
