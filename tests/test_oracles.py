"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from helixframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, pd.Timestamp):
        return str(x)
    return round(float(x), 6) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_channel_orders_devices_by_error(spark):
    rates = {r["profile"]: r["error_rate"] for r in registry.QUERIES["channel_stats"](spark, SF).collect()}
    assert rates["pristine"] == 0 < rates["twist"] < rates["illumina"] < rates["nanopore"]
