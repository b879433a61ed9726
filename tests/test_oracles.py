"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(df):
    df = df[sorted(df.columns)].astype(object)

    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


def names():
    from darkslide.oracles import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_rows(spark, sql, name):
    from darkslide.oracles import ORACLES
    from darkslide.queries import queries

    got, want = queries()[name](spark, DATA).toPandas(), sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
