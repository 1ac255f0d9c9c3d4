"""Frozen inputs: a tree of digests over many files, and what differs from it later.

Spark digests the chunks of each file where it reads it; a file's root is the digest of its chunks' digests, the
set's root that of the files'. Roots are compared first, and chunks only of files whose roots differ, so a changed byte
is named with its file and chunk. Files of up to 2 GB (Spark's limit for a binary value); larger inputs are many files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def digest_tree(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """(path, size, chunks, root) of each file. An empty file has no chunks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    at = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / chunk))).otherwise(F.array().cast("array<bigint>"))
    chunks = F.transform(at, lambda i: F.sha2(F.substring(F.col("content"), (i * chunk + 1).cast("int"), F.lit(chunk)), 256))
    return files.select("path", F.col("length").alias("size"), chunks.alias("chunks")).withColumn("root", F.sha2(F.concat_ws("", F.col("size").cast("string"), F.array_join("chunks", "")), 256))


def set_root(tree: DataFrame) -> str | None:
    """One digest of a set of files, whatever their order: the digest of the sum of their named roots."""
    named = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "root"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return tree.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(named).cast("string")), 256)).first()[0]


def changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state, chunks): missing, added or changed files; for changed ones the numbers of the chunks that differ, from 0."""
    a, b = frozen.select("path", "root", "chunks"), now.select("path", F.col("root").alias("root_b"), F.col("chunks").alias("chunks_b"))
    both = a.join(b, "path", "full_outer").where(~F.col("root").eqNullSafe(F.col("root_b")))
    most = F.greatest(F.size("chunks"), F.size("chunks_b"))
    at = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(at, lambda i: ~F.get("chunks", i).eqNullSafe(F.get("chunks_b", i)))
    state = F.when(F.col("root_b").isNull(), "missing").when(F.col("root").isNull(), "added").otherwise("changed")
    return both.select("path", state.alias("state"), F.when(state == "changed", differ).alias("chunks"))


def require_frozen(frozen: DataFrame, now: DataFrame, most: int = 20) -> None:
    """ValueError that names the first differing files and chunks."""
    if found := changes(frozen, now).orderBy("path").limit(most).collect():
        raise ValueError("; ".join(f"{r.path} is {r.state}" + (f" in chunks {', '.join(map(str, r.chunks))}" if r.chunks is not None else "") for r in found))


def publish(df: DataFrame, target: str, stale: tuple[str, ...] = ()) -> None:
    """Writes a table beside its target and puts it in place; results of an earlier run beside it that ``stale`` names go with that."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    at, part = path(target), path(f"{target}.{uuid.uuid4().hex}.part")
    df.write.parquet(part.toString())
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in (at, *(path(at.getParent(), name) for name in stale)):
        system.delete(old, True)
    if not system.rename(part, at):
        raise OSError(f"cannot put {target} in place")
