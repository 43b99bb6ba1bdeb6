"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from basalt.plans.catalogue import QUERIES, SQL
from basalt.session import TABLES

SF = os.environ.get("BASALT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).isoformat()
    return str(v)


def rows(names, data):
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, want.fetchall())
    else:
        assert got
