"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from starloom.plans import facade_queries  # noqa: F401
from starloom.plans import queries as plan

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(plan.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = plan.QUERIES[name](spark, DATA).toPandas(), con.execute(plan.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(plan.QUERIES) - set(plan.SQL)))
def test_query_runs(spark, con, name):
    assert plan.QUERIES[name](spark, DATA).columns


def test_entry(spark, con):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
