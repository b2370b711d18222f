"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from memloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
