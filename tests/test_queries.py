"""Each registered query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from emberline.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def key(row):
    return [(x is None, str(type(x)), x if x is not None else 0) for x in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert rows
    if name in SQL:
        want = con.sql(SQL[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
