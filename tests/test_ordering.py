"""Skew-safe ranks against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from evalmill.operators import ordering as O


def skewed(spark, n=4000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(50)}"
        value = 7.0 if rng.random() < 0.4 else float(rng.randrange(30)) / 3
        rows.append((group, value, i, float(rng.randrange(9))))
    return rows, spark.createDataFrame(rows, "g string, v double, id bigint, w double")


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Small tables in one range, and in as many as there are shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, old)


def test_running_rank_and_sum(spark, coalesced):
    rows, df = skewed(spark)
    out = O.running(df, ["g"], F.col("v"), F.col("id"), {"total": F.col("w")}).collect()
    assert len(out) == len(rows)
    got = {r["id"]: (r["rank"], r["total"]) for r in out}
    for g in {r[0] for r in rows}:
        total = 0.0
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            assert got[r[2]] == (place, total)


def test_running_without_groups_descending(spark, coalesced):
    rows, df = skewed(spark, 1500)
    out = O.running(df, [], -F.col("v"), F.col("id")).collect()
    expected = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert {r["id"]: r["rank"] for r in out} == expected


def test_running_on_no_rows(spark, coalesced):
    df = skewed(spark, 10)[1].filter("id < 0")
    assert O.running(df, ["g"], F.col("v"), F.col("id"), {"total": F.col("w")}).collect() == []


@pytest.mark.parametrize("coalesced", ["false"], indirect=True)
def test_ranges_split_the_hot_group(spark, coalesced):
    """The heavy value of the heavy group is cut by its tie column."""
    _, df = skewed(spark)
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, "16")
    dealt = O.range_slots(df, ["g", "v", "id"])
    spark.conf.set(key, old)
    assert dealt.select("_slot").distinct().count() == 16
    largest = dealt.groupBy("g", "_slot").count().agg(F.max("count")).first()[0]
    assert largest < df.filter("g = 'hot'").count() / 6


def test_smallest_is_exact(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    expected = sorted((r["h"], r["id"]) for r in df.collect())[:777]
    for direct in (10, 100_000):
        got = O.smallest(df, F.col("h"), "id", 777, direct=direct).collect()
        assert sorted((r["h"], r["id"]) for r in got) == expected


def test_smallest_with_equal_keys(spark):
    df = spark.range(100)
    got = O.smallest(df, F.lit(5).cast("bigint"), "id", 9, direct=1).collect()
    assert sorted(r["id"] for r in got) == list(range(9))


def test_top_k(spark):
    _, df = skewed(spark, 500)
    out = O.top_k(df, ["g"], [F.desc("v"), F.col("id")], 2)
    assert out.groupBy("g").count().agg(F.max("count")).first()[0] == 2


def test_dealt_takes_as_many_tasks_as_the_rows_ask_for(spark):
    df = spark.range(1000).selectExpr("id % 300 AS k", "id AS v")
    got = O.dealt(df, ["k"], slot_rows=100)
    assert got.rdd.getNumPartitions() == 10 and got.count() == 1000
