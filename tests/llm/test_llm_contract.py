"""Registered queries of this package against their SQL, on the smallest tables."""

import math
import os

import pytest

from rallyforge.llm import queries, sql

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    got = sorted(tuple(text(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    if name not in sql.ORACLE:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(sql.ORACLE[name]).df()
    assert sorted(want.columns) == sorted(df.columns)
    rows = want[sorted(want.columns)].astype(object).where(want[sorted(want.columns)].notna(), None)
    assert got == sorted(tuple(text(v) for v in r) for r in rows.itertuples(index=False, name=None))
