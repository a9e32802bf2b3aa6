import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from evalmill.functions.draws import uniform
from evalmill.operators import ratings as R
from evalmill.session import pin


def battles(spark, n=3000, seed=0, shift=0.0):
    rng = random.Random(seed)
    strength = {f"m{i}": 0.15 * i for i in range(5)}
    rows = []
    for i in range(n):
        a, b = rng.sample(sorted(strength), 2)
        p = 1 / (1 + 10 ** (strength[b] - strength[a]))
        u = rng.random()
        winner = "tie" if u < 0.1 else "model_a" if rng.random() < p else "model_b"
        rows.append((i % 2, i, a, b, winner, rng.randrange(1, 50), rng.randrange(1, 50)))
    return rows, spark.createDataFrame(rows, "pool int, pos bigint, model_a string, model_b string, winner string, la int, lb int")


def ratings(df):
    return {r["model"]: r["rating"] for r in df.collect()}


def test_bradley_terry_solves_the_score_equations(spark):
    rows, df = battles(spark)
    got = ratings(R.bradley_terry(R.pair_counts(df)))
    assert sum(got.values()) / len(got) == pytest.approx(1000)
    gap = dict.fromkeys(got, 0.0)
    for _, _, a, b, winner, *_ in rows:
        p = 1 / (1 + 10 ** ((got[b] - got[a]) / 400))
        y = {"model_a": 1.0, "model_b": 0.0, "tie": 0.5}[winner]
        gap[a] += y - p
        gap[b] -= y - p
    assert max(abs(v) for v in gap.values()) < 1e-3
    assert sorted(got, key=got.get) == ["m0", "m1", "m2", "m3", "m4"]


def test_anchoring_only_shifts(spark):
    _, df = battles(spark)
    free, held = ratings(R.bradley_terry(R.pair_counts(df))), ratings(R.bradley_terry(R.pair_counts(df), baseline="m2", baseline_rating=1200.0))
    assert held["m2"] == pytest.approx(1200)
    assert {m: held[m] - free[m] for m in free} == pytest.approx(dict.fromkeys(free, held["m0"] - free["m0"]))


def test_more_wins_never_lower_a_rating(spark):
    _, df = battles(spark)
    extra = spark.createDataFrame([(0, 9999 + i, "m1", "m3", "model_a", 1, 1) for i in range(100)], df.schema)
    before, after = ratings(R.bradley_terry(R.pair_counts(df))), ratings(R.bradley_terry(R.pair_counts(df.unionByName(extra))))
    assert after["m1"] > before["m1"] and after["m3"] < before["m3"]


def test_disconnected_models_are_reported(spark):
    rows = [("a", "b", "model_a"), ("b", "a", "model_a"), ("c", "d", "tie")]
    df = spark.createDataFrame(rows, "model_a string, model_b string, winner string")
    got = {r["model"]: r["component"] for r in R.bradley_terry(R.pair_counts(df)).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_bootstrap_interval_holds_the_estimate(spark):
    _, df = battles(spark)
    point = ratings(R.bradley_terry(R.pair_counts(df)))
    for r in R.intervals(R.bootstrap_bradley_terry(R.pair_counts(df), rounds=60)).collect():
        assert r["lower"] < point[r["model"]] < r["upper"] and r["std"] > 0


def brute_elo(rows, k=4.0):
    rating = {}
    for _, _, a, b, winner, *_ in rows:
        ra, rb = rating.get(a, 1000.0), rating.get(b, 1000.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        y = {"model_a": 1.0, "model_b": 0.0, "tie": 0.5}[winner]
        rating[a], rating[b] = ra + k * (y - e), rb + k * (e - y)
    return rating


def test_elo_in_pieces_equals_one_walk(spark):
    rows, df = battles(spark, 900)
    for chunk in (100, 10_000):
        got = R.online_elo(df.repartition(5), ["pool"], "pos", "pos", chunk=chunk).collect()
        for pool in (0, 1):
            expected = brute_elo([r for r in rows if r[0] == pool])
            assert {r["model"]: r["rating"] for r in got if r["pool"] == pool} == pytest.approx(expected)


def test_elo_over_many_passes_takes_as_many_jobs_as_the_rows_ask_for(spark, monkeypatch):
    """A pass takes several pieces: 900 battles in pieces of 10 were 45 passes a pool."""
    rows, df = battles(spark, 900)
    monkeypatch.setattr(R, "PASS_ROWS", 200)
    states = []
    monkeypatch.setattr(R, "pin", lambda d: states.append(d) or pin(d))
    got = R.online_elo(df.repartition(5), ["pool"], "pos", "pos", chunk=10).collect()
    assert 1 <= len(states) <= 4
    for pool in (0, 1):
        expected = brute_elo([r for r in rows if r[0] == pool])
        assert {r["model"]: r["rating"] for r in got if r["pool"] == pool} == pytest.approx(expected)


def test_a_battle_of_the_resampled_elo_is_drawn_once(spark):
    """The draw stood in the plan once for every cut: over 300 s for three rounds of 514,000 battles."""
    _, df = battles(spark, 20)
    seen = []
    original = R.online_elo
    try:
        R.online_elo = lambda rows, *a, **k: seen.append(rows) or original(rows, *a, **k)
        got = R.bootstrap_elo(df, "pos", "pos", rounds=2).collect()
    finally:
        R.online_elo = original
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    drawn = seen[0].groupBy("round", "pool", "pos").count().collect()
    cuts = R.poisson_cuts()
    u = {(r["round"], r["pos"]): r["u"] for r in df.crossJoin(spark.range(2).withColumnRenamed("id", "round")).select("round", "pos", uniform(0, "round", "pos", "pos").alias("u")).collect()}
    assert all(r["count"] == sum(c <= u[r["round"], r["pos"]] for c in cuts) for r in drawn) and len(got)


def test_resampled_elo_of_the_query_takes_every_round(spark, tmp_path, monkeypatch):
    """It took 3 rounds of 100, too few for points at 2.5 % and 97.5 %."""
    rng = random.Random(5)
    rows = [(i // 3, rng.randrange(1000), rng.randrange(50), i % 3, float(i % 9), 0.01, "ANR"[i % 3]) for i in range(150)]
    types = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, types).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, intervals = [], R.intervals
    monkeypatch.setattr(R, "intervals", lambda r, *a: seen.append(r) or intervals(r, *a))
    got = [tuple(r) for r in entry.queries()["g24_bootstrap_elo"](spark, str(tmp_path)).collect()]
    assert {(r["round"], r["model"]) for r in seen[0].collect()} == {(i, f"m{m}") for i in range(100) for m in range(7)}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    expected = {r[0]: r[1:] for r in con.execute(entry.oracle_sql()["g24_bootstrap_elo"]).fetchall()}
    assert len(got) == 7 and all(r[1:] == pytest.approx(expected[r[0]], abs=2e-6) for r in got)


def test_resampled_elo_equals_a_walk_of_the_copies(spark, monkeypatch):
    """Rounds are packed from one sorted table, in several buffers, pieces and passes."""
    rows, df = battles(spark, 400)
    monkeypatch.setattr(R, "PACK_ROWS", 150)
    monkeypatch.setattr(R, "PASS_ROWS", 120)
    monkeypatch.setattr(R, "OUT_ROWS", 2)
    got = R.bootstrap_elo(df.repartition(5), "pos", "pos", rounds=6, seed=3, chunk=40).collect()
    u = df.crossJoin(spark.range(6).withColumnRenamed("id", "round")).select("round", "pos", uniform(3, "round", "pos", "pos").alias("u")).collect()
    copies = {(r["round"], r["pos"]): sum(c <= r["u"] for c in R.poisson_cuts()) for r in u}
    for i in range(6):
        expected = brute_elo([r for r in rows for _ in range(copies[i, r[1]])])
        assert {r["model"]: r["rating"] for r in got if r["round"] == i} == pytest.approx(expected, rel=1e-12)


def test_elo_of_many_models_and_pools_of_two_keys(spark, monkeypatch):
    """A piece with over 256 different battles numbers them by two bytes; a pool without a name is left out, a model without one is not."""
    rng = random.Random(2)
    models = [f"m{i}" for i in range(40)] + [None]
    rows = [(i % 3, "xy"[i % 2], i, *rng.sample(models, 2), rng.choice(["model_a", "model_b", "tie", None])) for i in range(3000)] + [(None, "x", 1, "m0", "m1", "tie")]
    df = spark.createDataFrame(rows, "p int, q string, pos bigint, model_a string, model_b string, winner string")
    got = R.online_elo(df.repartition(5), ["p", "q"], "pos", "pos").collect()
    assert {(r["p"], r["q"]) for r in got} == {(p, q) for p in range(3) for q in "xy"}
    known = [(0, i, a, b, w or "tie", p, q) for p, q, i, a, b, w in rows]
    for p in range(3):
        for q in "xy":
            expected = brute_elo([r for r in known if r[5:] == (p, q)])
            assert {r["model"]: r["rating"] for r in got if (r["p"], r["q"]) == (p, q)} == pytest.approx(expected)
    assert R.online_elo(df, [], "pos", "pos").count() == len(models)
    assert R.online_elo(df.limit(0), ["p"], "pos", "pos").collect() == []


def test_style_control_recovers_a_length_effect(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        a, b = rng.sample(["x", "y", "z"], 2)
        la, lb = rng.randrange(1, 100), rng.randrange(1, 100)
        p = 1 / (1 + math.exp(-3 * (la - lb) / (la + lb + 1)))
        rows.append((a, b, "model_a" if rng.random() < p else "model_b", la, lb))
    df = spark.createDataFrame(rows, "model_a string, model_b string, winner string, la int, lb int")
    got, odds = R.style_controlled(df, [("length", "la", "lb")])
    assert max(abs(v - 1000) for v in ratings(got).values()) < 40
    diffs = np.array([(r[3] - r[4]) / (r[3] + r[4] + 1) for r in rows])
    assert math.log(odds.first()["odds_ratio"]) / diffs.std() == pytest.approx(3, rel=0.15)


def test_confidence_rank_and_win_rate(spark):
    df = spark.createDataFrame([("a", 1100.0, 1090.0, 1110.0), ("b", 1085.0, 1080.0, 1095.0), ("c", 1000.0, 990.0, 1010.0)], "model string, rating double, lower double, upper double")
    assert {r["model"]: r["rank"] for r in R.confidence_rank(df).collect()} == {"a": 1, "b": 1, "c": 3}
    rates = {(r["model_a"], r["model_b"]): r["win_rate"] for r in R.expected_win_rates(df).collect()}
    assert rates["a", "c"] + rates["c", "a"] == pytest.approx(1) and rates["a", "c"] == pytest.approx(1 / (1 + 10 ** (-100 / 400)))
