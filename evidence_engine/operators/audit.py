"""Cross-checks of a release: whether written records, candidates, holdouts and a summary say the same.

Multisets are compared without sorting or pairing rows: each bucket has a digest, the number of its rows and the
sums of two hashes of them, which does not depend on order and is counted partially before the shuffle. Rows of
buckets with equal digests never meet; only where digests differ is the exact difference taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import text
from .relational import multiset_diff

#: Buckets of rows without a bucket of their own.
PARTS = 256


def digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, first, second): equal multisets of rows have equal digests, others differ but for two colliding sums."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), hashed(1).alias("first"), hashed(2).alias("second"))


def differences(a: DataFrame, b: DataFrame, columns: list[str], parts: int = PARTS) -> DataFrame:
    """(columns, surplus): how many more of a row a has than b. Rows are dealt into parts by hash; only parts whose digests differ are compared row by row."""
    part = F.pmod(F.xxhash64(*columns), F.lit(parts))
    x, y = (df.select(*columns).withColumn("__part", part) for df in (a, b))
    one, two = digests(x, ["__part"], columns), digests(y, ["__part"], columns).withColumnsRenamed({c: f"{c}_b" for c in ("__part", "rows", "first", "second")})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("rows", "first", "second")]
    unlike = one.join(two, F.col("__part") == F.col("__part_b"), "full_outer").where(~reduce(Column.__and__, same)).select(F.coalesce("__part", "__part_b").alias("__part"))
    # At most ``parts`` rows.
    return multiset_diff(x.join(F.broadcast(unlike), "__part", "left_semi"), y.join(F.broadcast(unlike), "__part", "left_semi"), columns)


def split_contract(records: DataFrame, candidates: DataFrame, holdouts: DataFrame, summary: DataFrame, buckets: DataFrame) -> DataFrame:
    """(check_name, expected, actual, passed): the counts, contents and buckets on which a release must agree.

    records: split, question, answer as written for training. candidates: split, sft_bucket, question, answer.
    holdouts: split. summary: name, rows as declared. buckets: split, sft_bucket, rows as declared. A content check
    counts the question and answer pairs that one side has more often, a bucket check the buckets that differ.
    """
    declared = summary.groupBy("name").agg(F.max("rows").alias("rows"))
    counted = reduce(DataFrame.unionByName, [
        df.groupBy("split").agg(F.count("*").alias("n")).select(F.concat(F.lit(prefix), F.col("split"), F.lit(suffix)).alias("check_name"), F.concat("split", F.lit("_rows")).alias("name"), "n")
        for df, prefix, suffix in ((records, "", "_records"), (candidates.where("split in ('train', 'valid')"), "", "_candidates"), (holdouts, "", "_holdout"))
    ])
    wanted = [(f"{s}_{kind}", f"{s}_rows") for kind in ("records", "candidates") for s in ("train", "valid")] + [(f"{s}_holdout", f"{s}_rows") for s in ("holdout_grounded_generation", "holdout_edge_safety")]
    names = records.sparkSession.createDataFrame(wanted, "check_name string, name string")
    counts = names.join(declared, "name", "left").join(counted.drop("name"), "check_name", "left").select("check_name", F.coalesce("rows", F.lit(0)).cast("bigint").alias("expected"), F.coalesce("n", F.lit(0)).cast("bigint").alias("actual"))
    pair = lambda df: df.where("split in ('train', 'valid')").select("split", text(F.col("question"), weak=True).alias("question"), text(F.col("answer"), weak=True).alias("answer"))
    unlike = differences(pair(records), pair(candidates), ["split", "question", "answer"]).groupBy("split").agg(F.count("*").alias("n"))
    made = candidates.where("split in ('train', 'valid')").groupBy("split", "sft_bucket").agg(F.count("*").cast("bigint").alias("rows"))
    of_bucket = differences(made, buckets.select("split", "sft_bucket", F.col("rows").cast("bigint").alias("rows")), ["split", "sft_bucket", "rows"]).groupBy("split").agg(F.count_distinct("sft_bucket").alias("n"))
    two = records.sparkSession.createDataFrame([("train",), ("valid",)], "split string")
    zero = lambda found, what: two.join(found, "split", "left").select(F.concat("split", F.lit(what)).alias("check_name"), F.lit(0).cast("bigint").alias("expected"), F.coalesce("n", F.lit(0)).cast("bigint").alias("actual"))
    return reduce(DataFrame.unionByName, [counts, zero(unlike, "_content"), zero(of_bucket, "_buckets")]).withColumn("passed", F.col("expected") == F.col("actual"))
