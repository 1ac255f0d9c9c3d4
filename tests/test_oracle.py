"""Every query with SQL: the same rows from Spark and from DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from evidence_engine.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return float(v) if isinstance(v, (int, float, np.integer, np.floating)) else v

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, sf, duck):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
