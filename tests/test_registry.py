"""Queries against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(float(v[i]), 5) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else v[i] for i in order) for v in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
