"""Order statistics against brute force: ties, NaN, nulls, infinities, many distinct values, no single partition."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import order


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ordinals_are_consecutive(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), None if i % 50 == 0 else int(v)) for i, v in enumerate(rng.integers(0, 20, 3000))]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    out = order.with_ordinal(df, [F.desc("v"), "i"], partitions=7)
    assert "SinglePartition" not in plan(out) and "Window" not in plan(out)
    got = [(r.i, r.v) for r in sorted(out.collect(), key=lambda r: r.ordinal)]
    assert sorted(r.ordinal for r in out.collect()) == list(range(1, 3001))
    assert got == sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert order.with_ordinal(df.limit(0), ["i"]).count() == 0
    ids = order.sequential_ids(df.where("i < 3"), ["i"], "id", "APT_%02d").orderBy("i").collect()
    assert [r.id for r in ids] == ["APT_01", "APT_02", "APT_03"]


@pytest.mark.parametrize("n,stretch", [(1, 10), (4, 3), (4, 100), (25, 7)])
def test_trailing_rows_cross_stretches(spark, n, stretch):
    values = np.random.default_rng(1).integers(0, 100, 211).astype(float).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(4)
    out = order.trailing(df, ["i"], n, {"mean": F.avg("v"), "rows": F.count("*")}, stretch)
    assert "SinglePartition" not in plan(out)
    got = {r.i: (r.mean, r.rows) for r in out.collect()}
    assert len(got) == len(values)
    for i in range(len(values)):
        held = values[max(0, i - n + 1) : i + 1]
        assert got[i] == (pytest.approx(sum(held) / len(held)), len(held))


@pytest.mark.parametrize("fit", [1, 50, 10_000])
def test_quantiles(spark, fit):
    rng = np.random.default_rng(2)
    shares = [0.0, 0.1, 0.33, 0.5, 0.67, 0.95, 1.0]
    for values in ([5.0], [1.0, 2.0], [3.0] * 500, rng.integers(0, 9, 2000).astype(float).tolist(), rng.lognormal(0, 9, 3000).tolist(), [-1.7e308, 1.7e308, 0.0, 1e-300] * 30, rng.normal(0, 1e-12, 700).tolist()):
        mixed = [(x,) for x in values] + [(None,), (float("nan"),)]
        df = spark.createDataFrame(mixed, "x double")
        want = np.quantile(np.array(values) / 2, shares) * 2 if max(map(abs, values)) > 1e300 else np.quantile(values, shares)
        assert order.quantiles(df, "x", shares, fit=fit, bins=16) == pytest.approx(want.tolist(), rel=1e-12, abs=1e-30)
    assert order.quantiles(spark.createDataFrame([(None,), (float("nan"),)], "x double"), "x", [0.5]) == [None]
    assert order.quantiles(spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double"), "x", [0.0, 0.5, 1.0]) == [float("-inf"), 1.0, float("inf")]


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("x"))
    held = np.sort(np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003).astype(float)
    assert order.quantiles(df, "x", [0.33, 0.95]) == pytest.approx(np.quantile(held, [0.33, 0.95]).tolist(), rel=1e-12)


def test_first_by_hash(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{int(b)}", f"id{i}") for i, b in enumerate(rng.integers(0, 4, 4000))] + [("b0", "id0"), ("lone", "x")]
    quota = {"b0": 17, "b1": 0, "b2": 10_000, "b3": 1, "lone": 1}
    df = spark.createDataFrame(rows, "b string, id string")
    digest = F.sha2(F.concat(F.lit("salt||"), "id"), 256)
    out = order.within_quota(df, "b", digest, "id", spark.createDataFrame(list(quota.items()), "b string, quota int"), "first")
    assert "Window" not in plan(out)
    got = sorted((r.b, r.id) for r in out.where("first").collect())
    want = []
    for b, q in quota.items():
        own = sorted((hashlib.sha256(f"salt||{i}".encode()).hexdigest(), i) for x, i in rows if x == b)
        want += [(b, i) for _, i in own[:q]]
    assert got == sorted(want) and out.count() == len(rows)
