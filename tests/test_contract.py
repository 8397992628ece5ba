"""Every registered query against its SQL, over whole tables of the smallest size."""

import math
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
NAMES = [n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit() or n.startswith(("p2_", "p4_"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([*v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float, bool, np.number, np.bool_)) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
