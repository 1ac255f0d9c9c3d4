"""Order statistics without a window over everything: ordinals, trailing rows, quantiles, first rows by hash.

A total order over a whole table never needs one task. Ordinals come from range partitions and the sums of their
counts; trailing rows from stretches of consecutive ordinals, each with the few rows before it; a quantile from
counts of ever narrower bins, until what is left fits; the first rows of a bucket by hash from counts of hash
prefixes. What comes to the driver or into one group is bounded by the number of partitions, bins or buckets.
"""

from __future__ import annotations

from math import ceil, floor, inf, isinf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Rows of a stretch of consecutive ordinals.
STRETCH = 100_000
#: Bins of a round of a quantile's search, and values that are sorted as they are.
BINS, FIT = 1024, 10_000


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal", start: int = 1, partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Numbers the rows start, start + 1 ... in their order, nulls first; a written table. The order must be total, or equal rows are numbered as they come.

    Range partitions follow one another, so a row's number is its place in its own plus the sizes of those before.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # partition << 33 | place in it
    placed = (scratch or Scratch(spark, "ordinal")).settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", place))
    part = F.shiftright("__place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, total = [], start
    for p, count in sizes:
        before.append((p, total))
        total += count
    offsets = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__place")


def sequential_ids(df: DataFrame, order: list[str | Column], name: str, pattern: str = "APT_%06d") -> DataFrame:
    """Ids of the rows' ordinals; numbers of more digits than the pattern has keep them all."""
    return with_ordinal(df, order, "__ordinal").withColumn(name, F.format_string(pattern, F.col("__ordinal"))).drop("__ordinal")


def trailing(df: DataFrame, order: list[str | Column], n: int, values: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """Adds aggregates over the last n rows up to each one in a total order of the whole table.

    Rows meet in stretches of consecutive ordinals; the last n - 1 of a stretch also stand before the next one.
    """
    from pyspark.sql import Window

    numbered, size = with_ordinal(df, order, "__ordinal", 0), max(stretch, n - 1)
    own = F.floor(F.col("__ordinal") / size)
    halo = F.col("__ordinal") % size >= size - (n - 1)
    dealt = numbered.withColumn("__stretch", F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__stretch").orderBy("__ordinal").rowsBetween(-(n - 1), 0)
    out = dealt.withColumns({name: value.over(w) for name, value in values.items()})
    return out.where(F.col("__stretch") == own).drop("__ordinal", "__stretch")


def quantiles(df: DataFrame, column: str, shares: list[float], bins: int = BINS, fit: int = FIT) -> list[float | None]:
    """Exact quantiles, interpolated between the two nearest values; null and NaN do not count, of no value all are None.

    Each round counts the values of the bins of the stretches that hold wanted ranks; a bin with one distinct
    value is settled whatever its count, a bin of up to ``fit`` values is sorted, others are cut up again.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    kind = F.when(v == -inf, 0).when(v == inf, 2).otherwise(1)
    counted = [(0, r.kind, r.n, r.least, r.most) for r in values.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()]
    total = sum(c[2] for c in counted)
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * p for p in shares]
    found: dict[int, float] = {}
    stretches: list[tuple[int, list[int]]] = [(0, sorted({r for x in at for r in (floor(x), ceil(x))}))]  # values below, wanted ranks
    while True:
        following: list[tuple[float, float, int, list[int]]] = []
        for i, (below, ranks) in enumerate(stretches):
            for _, _, n, least, most in sorted(c for c in counted if c[0] == i):
                mine = [r for r in ranks if below <= r < below + n]
                if mine and least == most:
                    found |= dict.fromkeys(mine, least)
                elif mine and n <= fit:
                    held = [r.v for r in values.where((v >= least) & (v <= most)).orderBy("v").collect()]
                    found |= {r: held[r - below] for r in mine}
                elif mine:
                    following.append((least, most, below, mine))
                below += n
        if not following:
            break
        which = bin_of = F
        for i, (least, most, _, _) in enumerate(following):
            inside = (v >= least) & (v <= most)
            half = 0.5 if isinf(most - least) else 1.0
            which = which.when(inside, i)
            bin_of = bin_of.when(inside, F.floor((v * half - least * half) / (most * half - least * half) * bins))
        rows = values.select("v", which.alias("i"), bin_of.alias("bin")).where("i is not null").groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        counted, stretches = [(r.i, r.bin, r.n, r.least, r.most) for r in rows], [(below, ranks) for _, _, below, ranks in following]
    between = lambda x: found[floor(x)] if floor(x) == ceil(x) else (ceil(x) - x) * found[floor(x)] + (x - floor(x)) * found[ceil(x)]
    return [between(x) for x in at]


def with_quantiles(df: DataFrame, column: str, low: float = 0.33, high: float = 0.67, prefix: str = "q") -> DataFrame:
    """The two quantiles of the whole column beside every row."""
    found = quantiles(df, column, [low, high])
    return df.withColumns({f"{prefix}_{name}": F.lit(q).cast("double") for name, q in zip(("low", "high"), found)})


def hash_cuts(df: DataFrame, by: str, digest: Column, id_col: str, quota: DataFrame, digits: int = 4) -> DataFrame:
    """(by, cut): of each bucket the (digest, id) of the row that is the quota-th by digest and id; no row for a quota of 0, a null cut where the bucket has no more.

    quota: (by, quota). Two counts of prefixes of the hexadecimal digest leave the rows of one prefix of twice
    ``digits`` digits, and of those the cut is chosen. A bucket has 16 ** digits prefixes at most.
    """
    rows = df.select(F.col(by).alias("b"), digest.alias("d"), F.col(id_col).alias("id"))
    asked = quota.select(F.col(by).alias("b"), F.col("quota").cast("bigint").alias("more")).where("more > 0")
    left = asked.withColumn("prefix", F.lit(""))
    for step in range(2):
        prefix = F.substring("d", 1, digits * (step + 1))
        open_rows = rows.join(left.select("b", "prefix"), "b").where(F.substring("d", 1, digits * step) == F.col("prefix")) if step else rows
        counts = open_rows.groupBy("b", prefix.alias("p")).agg(F.count("*").alias("n")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("counts"))
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("bigint").alias("more"))

        def pick(acc, x):
            here = acc["p"].isNull() & (acc["sum"] + x["n"] >= F.col("want"))
            return F.struct((acc["sum"] + x["n"]).alias("sum"), F.when(here, x["p"]).otherwise(acc["p"]).alias("p"), F.when(here, F.col("want") - acc["sum"]).otherwise(acc["more"]).alias("more"))

        joined = left.select("b", F.col("more").alias("want")).join(counts, "b")
        left = joined.select("b", F.aggregate("counts", start, pick).alias("a")).select("b", F.col("a.p").alias("prefix"), F.col("a.more").alias("more")).where("prefix is not null")
    inside = rows.join(left, "b").where(F.substring("d", 1, 2 * digits) == F.col("prefix"))
    chosen = inside.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("l"), F.first("more").alias("more")).select("b", F.get("l", F.col("more").cast("int") - 1).alias("cut"))
    return asked.select("b").join(chosen, "b", "left").select(F.col("b").alias(by), "cut")


def within_quota(df: DataFrame, by: str, digest: Column, id_col: str, quota: DataFrame, name: str) -> DataFrame:
    """Adds a flag: whether a row is among the first of its bucket by digest and id, as many as the bucket's quota. ``quota`` has a row a bucket."""
    cuts = hash_cuts(df, by, digest, id_col, quota).withColumn("__open", F.lit(True))
    joined = df.join(cuts, by, "left")
    own = F.struct(digest.alias("d"), F.col(id_col).alias("id"))
    return joined.withColumn(name, F.coalesce(F.col("__open") & (F.col("cut").isNull() | (own <= F.col("cut"))), F.lit(False))).drop("__open", "cut")
