"""Every described query against the same question in DuckDB."""

import os

import duckdb
import pytest

from tidemill.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 50


def test_plans(spark):
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("newest_10_events_per_type")
    assert "TakeOrderedAndProject" in plan("top_3_orders")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan("latest_error_per_user")
    assert "LeftAnti" in plan("orders_without_lines") and "Python" not in plan("redacted_digests")


def test_reach_over_long_chains(spark):
    from tidemill.operators.reach import reachable

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(66)], "src long, dst long")
        got = {(r.src, r.dst): r.hops for r in reachable(spark, edges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == {(i, j): j - i for i in range(67) for j in range(i + 1, 67)}
