"""The corpus queries that have SQL against it, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from emberline.llm.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return list(map(plain, v.values())) if isinstance(v, dict) else v


def test_sql_is_text():
    assert {k for k, v in __spark_entry__.oracle_sql().items() if not isinstance(v, str)} == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    df = QUERIES[name](spark, DIR)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
