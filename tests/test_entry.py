"""Every query runs on the smallest tables, and those that have a twin agree with it."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as e

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in e.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        if pd.isna(v):
            return ""
        return f"{v:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = e.queries()[name](spark, SF).toPandas()
    assert len(got.columns)
    if sql := e.oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry(spark):
    assert e.entry(spark).count() > 0
