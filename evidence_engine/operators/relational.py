"""Relational building blocks. Order is always an explicit, total key, never the rows' accidental position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import sha_rank


def _ordered(order: list, descending: bool) -> list[Column]:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return [c.desc() for c in cols] if descending else cols


def keep_one(df: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row of each key by the given order; a ranking window that Spark limits before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*_ordered(order, last))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dup_masks(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key)
    return df.withColumns({"is_repeat": F.row_number().over(w.orderBy(*order)) > 1, "is_shared": F.count("*").over(w) > 1})


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values by frequency, ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_last(column))
    return out if most is None else out.limit(most)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, nulls) in one pass."""
    columns = columns or df.columns
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot([], columns, "column_name", "nulls")


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct row: one aggregate of partial counts."""
    g = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("__c"))
    return g.agg(F.sum(F.col("__c") - 1).cast("bigint").alias("duplicates"))


def hash_ranked(df: DataFrame, id_col: str, salt: str, take: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows in the order of a salted hash of their id, the first ``take`` of all or of each group."""
    rank = sha_rank(salt, F.col(id_col))
    if by is None and take is not None:
        return df.orderBy(rank, id_col).limit(take)  # each task keeps ``take`` rows
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(rank, id_col)
    out = df.withColumn("hash_rank", F.row_number().over(w))
    return out if take is None else out.where(F.col("hash_rank") <= take)


def top_k(df: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def pick_extreme(df: DataFrame, by: list[str], column: str, id_col: str, largest: bool = False) -> DataFrame:
    """The id of each group's extreme row: nulls never win while another value is there, ties go to the smaller id."""
    key = F.struct(F.col(column).isNull().alias("n"), (-F.col(column) if largest else F.col(column)).alias("v"), F.col(id_col).alias("i"))
    return df.groupBy(*by).agg(F.min(key)["i"].alias("picked"))


def ensure_columns(df: DataFrame, columns: list[str], value: str = "") -> DataFrame:
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def require_columns(df: DataFrame, columns: list[str], name: str = "input") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")


def rename(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The renamed frame and the pairs that took effect."""
    pairs = [(a, b) for a, b in names.items() if a in df.columns]
    return df.withColumnsRenamed(dict(pairs)), pairs


def project(df: DataFrame, wanted: list[str], rest: bool = False) -> DataFrame:
    """The wanted columns that exist, in that order; the others after them if asked for."""
    first = [c for c in wanted if c in df.columns]
    return df.select(*first, *([c for c in df.columns if c not in first] if rest else []))


def unique_names(names: list[str]) -> list[str]:
    """White space and '/' to '_', brackets dropped, runs of '_' as one; repeated names get _1, _2 and so on."""
    import re

    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = re.sub(r"_+", "_", re.sub(r"[()]", "", re.sub(r"[\s/]+", "_", n.strip()))).strip("_")
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}_{seen[n]}")
    return out


def slice_rows(df: DataFrame, ordinal: str, offset: int, limit: int | None = None) -> DataFrame:
    out = df.where(F.col(ordinal) >= offset)
    return out if limit is None else out.where(F.col(ordinal) < offset + limit)


def resume(todo: DataFrame, done: DataFrame, key: str, legacy: str | None = None) -> DataFrame:
    """Rows not done yet, by key; rows without a key by ``legacy`` text."""
    left = todo.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    if legacy:
        left = left.join(done.where(F.col(key).isNull()).select(legacy).distinct(), legacy, "left_anti")
    return left


def metric_outer(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("left_value", "right_value")) -> DataFrame:
    """(metric, left, right, delta) over the union of both sides' metrics."""
    x, y = a.select("metric", F.col("value").alias(names[0])), b.select("metric", F.col("value").alias(names[1]))
    return x.join(y, "metric", "full_outer").withColumn("delta", F.col(names[1]) - F.col(names[0]))


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, surplus): how many more of a row a has than b, where not zero."""
    both = a.select(*columns, F.lit(1).alias("__w")).unionByName(b.select(*columns, F.lit(-1).alias("__w")))
    return both.groupBy(*columns).agg(F.sum("__w").alias("surplus")).where("surplus <> 0")


def schema_diff(declared: list[str], read: list[str], written: list[str]) -> dict[str, list[str]]:
    """The seven classes of columns by which of three contracts has them."""
    d, r, w = set(declared), set(read), set(written)
    kinds = {"all": d & r & w, "declared_read": (d & r) - w, "declared_written": (d & w) - r, "read_written": (r & w) - d, "declared_only": d - r - w, "read_only": r - d - w, "written_only": w - d - r}
    return {k: sorted(v) for k, v in kinds.items()}


def set_classes(declared: DataFrame, read: DataFrame, written: DataFrame, name: str) -> DataFrame:
    """(kind, names): the same seven classes of the distinct names of three frames, each class's names in order; classes without a name have none."""
    sides = reduce(DataFrame.unionByName, (df.select(F.col(name).alias("name"), F.lit(1 << i).alias("bit")) for i, df in enumerate((declared, read, written))))
    bits = sides.where(F.col("name").isNotNull()).groupBy("name").agg(F.bit_or("bit").alias("bits"))
    kinds = {7: "all", 3: "declared_read", 5: "declared_written", 6: "read_written", 1: "declared_only", 2: "read_only", 4: "written_only"}
    kind = F.coalesce(*(F.when(F.col("bits") == b, k) for b, k in kinds.items()))
    return bits.groupBy(kind.alias("kind")).agg(F.sort_array(F.collect_list("name")).alias("names"))


def unmatched_left(left: DataFrame, right: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_pred", "_base")) -> DataFrame:
    """Left join with both sides' columns suffixed; the right side must be unique on the key."""
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in left.columns if c not in key})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in right.columns if c not in key})
    return a.join(b.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unique_lookup(df: DataFrame, text: str, value: str) -> DataFrame:
    """(text, value) of texts that stand in one row only."""
    return df.groupBy(text).agg(F.count("*").alias("__c"), F.min(value).alias(value)).where("__c = 1").drop("__c")
