"""Every registered query with a SQL twin gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, name):
    """Without SQL: rows come, and a second run gives the same ones."""
    first = [str(r) for r in QUERIES[name](spark, FOLDER).collect()]
    again = [str(r) for r in QUERIES[name](spark, FOLDER).collect()]
    assert first and sorted(first) == sorted(again)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and df.columns[:2] == ["dataset", "metric"]
