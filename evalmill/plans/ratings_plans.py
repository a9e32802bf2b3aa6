"""Queries over ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions.draws import bits, sql_bits, sql_uniform
from evalmill.operators import ratings as R
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6
from evalmill.session import pin

BATTLES = with_tables("ev_battles")


@query("g21_pair_counts", BATTLES + """
SELECT category, model_a, model_b, CASE winner WHEN 'model_a' THEN 1e0 WHEN 'model_b' THEN 0e0 ELSE 0.5e0 END AS outcome, count(*) * 1e0 AS n FROM ev_battles GROUP BY ALL""")
def _(t):
    return R.pair_counts(t.ev_battles, ["category"])


@query("g21_bradley_terry")
def _(t):
    return R.bradley_terry(R.pair_counts(t.ev_battles), baseline="m0")


@query("g21_score_equations", BATTLES + """
, w AS (SELECT model_a AS model, CASE winner WHEN 'model_a' THEN 1e0 WHEN 'model_b' THEN 0e0 ELSE 0.5e0 END AS won FROM ev_battles
 UNION ALL SELECT model_b, CASE winner WHEN 'model_a' THEN 0e0 WHEN 'model_b' THEN 1e0 ELSE 0.5e0 END FROM ev_battles)
SELECT model, round(sum(won), 3) AS won, round(sum(won), 3) AS expected FROM w GROUP BY model""")
def _(t):
    """A fit is right if every model wins as often as its ratings say."""
    counts = R.pair_counts(t.ev_battles)
    fit = pin(R.bradley_terry(counts, baseline="m0").select("model", "rating"))
    a, b = fit.toDF("model_a", "ra"), fit.toDF("model_b", "rb")
    said = 1 / (1 + F.pow(F.lit(10.0), (F.col("rb") - F.col("ra")) / 400))
    side = lambda model, won, expected: F.struct(model.alias("model"), (F.col("n") * won).alias("won"), (F.col("n") * expected).alias("expected"))
    sides = F.array(side(F.col("model_a"), F.col("outcome"), said), side(F.col("model_b"), 1 - F.col("outcome"), 1 - said))
    rows = counts.join(a, "model_a").join(b, "model_b").select(F.explode(sides).alias("s")).select("s.*")
    return rows.groupBy("model").agg((F.round(F.sum("won"), 3) + 0.0).alias("won"), (F.round(F.sum("expected"), 3) + 0.0).alias("expected"))


@query("g21_bradley_terry_by_category")
def _(t):
    return R.bradley_terry(R.pair_counts(t.ev_battles, ["category"]), ["category"])


def bootstrapped(t):
    return R.bootstrap_bradley_terry(R.pair_counts(t.ev_battles), rounds=40, baseline="m0")


@query("g22_bootstrap_intervals")
def _(t):
    return R.intervals(bootstrapped(t))


@query("g23_style_controlled")
def _(t):
    ratings, _ = R.style_controlled(t.ev_battles, [("length", "len_a", "len_b")], ["category"], baseline="m0")
    return ratings


def in_order(t):
    """Battles with a tie-breaker, as several may belong to one item; battles that are alike may change places."""
    return t.wide("ev_battles").withColumn("tie", bits(0, "pos", "model_a", "model_b", "winner", "category"))


MODELS = BATTLES + """
, m AS (SELECT list(model ORDER BY model) AS ms FROM (SELECT model_a AS model FROM ev_battles UNION SELECT model_b FROM ev_battles)),
g AS (SELECT category, item_id, """ + sql_bits(0, "pos", "model_a", "model_b", "winner", "category") + """ AS tie, {'a': list_position(ms, model_a), 'b': list_position(ms, model_b), 'w': CASE winner WHEN 'model_a' THEN 1e0 WHEN 'model_b' THEN 0e0 ELSE 0.5e0 END} AS x FROM ev_battles, m)"""
EXPECTED = "(1 / (1 + pow(10e0, (r[x.b] - r[x.a]) / 400)))"
WALK = f"""list_reduce(games, lambda r, x: list_transform(r, lambda v, i: CASE i WHEN x.a THEN v + 4 * (x.w - {EXPECTED}) WHEN x.b THEN v + 4 * ({EXPECTED} - x.w) ELSE v END),
 list_transform(ms, lambda s: 1000e0))"""
COPIES = " + ".join(f"CASE WHEN {sql_uniform(0, 'round', 'item_id', 'tie')} >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in R.poisson_cuts())


@query("g24_online_elo", MODELS + f"""
, l AS (SELECT category, list(x ORDER BY item_id, tie) AS games FROM g GROUP BY category), w AS (SELECT category, ms, games, {WALK} AS r FROM l, m),
u AS (SELECT category, games, unnest(ms) AS model, unnest(r) AS rating, generate_subscripts(ms, 1) AS i FROM w)
SELECT category, model, round(rating, 6) AS rating FROM u WHERE len(list_filter(games, lambda x: x.a = i OR x.b = i)) > 0""")
def _(t):
    return round6(R.online_elo(in_order(t), ["category"], "item_id", "tie", chunk=100_000))


@query("g24_bootstrap_elo", MODELS + f"""
, c AS (SELECT CAST(round AS INT) AS round, item_id, tie, x, {COPIES} AS n FROM g, range(100) t(round)),
l AS (SELECT round, flatten(list(list_transform(range(n), lambda k: x) ORDER BY item_id, tie)) AS games FROM c GROUP BY round), w AS (SELECT round, ms, games, {WALK} AS r FROM l, m),
u AS (SELECT games, unnest(ms) AS model, unnest(r) AS rating, generate_subscripts(ms, 1) AS i FROM w)
SELECT model, round(quantile_cont(rating, 0.5), 6) AS rating, round(quantile_cont(rating, 0.025), 6) AS lower, round(quantile_cont(rating, 0.975), 6) AS upper, round(stddev_pop(rating), 6) AS std
FROM u WHERE len(list_filter(games, lambda x: x.a = i OR x.b = i)) > 0 GROUP BY model""")
def _(t):
    return round6(R.intervals(R.bootstrap_elo(in_order(t), "item_id", "tie")))


# ratings that both engines can compute: mean score of a model's battles, with a spread of one point
SIMPLE = BATTLES + """
, r AS (SELECT model_a AS model, avg(CASE winner WHEN 'model_a' THEN 100e0 WHEN 'tie' THEN 50e0 ELSE 0e0 END) + 1000 AS rating FROM ev_battles GROUP BY model_a),
b AS (SELECT model, rating, rating - 0.3 AS lower, rating + 0.3 AS upper FROM r)
"""


def simple(t):
    points = F.when(F.col("winner") == "model_a", 100.0).when(F.col("winner") == "tie", 50.0).otherwise(0.0)
    rows = t.ev_battles.groupBy(F.col("model_a").alias("model")).agg((F.avg(points) + 1000).alias("rating"))
    return rows.withColumn("lower", F.col("rating") - 0.3).withColumn("upper", F.col("rating") + 0.3)


@query("g25_confidence_rank", SIMPLE + """
SELECT a.model, round(a.rating, 6) AS rating, CAST(1 + count(b.model) AS INT) AS rank FROM b a LEFT JOIN b ON b.lower > a.upper GROUP BY a.model, a.rating""")
def _(t):
    return round6(R.confidence_rank(simple(t)).select("model", "rating", "rank"))


@query("g25_battles_per_model", BATTLES + """
SELECT model, count(*) AS battles FROM (SELECT model_a AS model FROM ev_battles UNION ALL SELECT model_b FROM ev_battles) GROUP BY model""")
def _(t):
    return R.battles_per_model(t.ev_battles)


@query("g26_expected_win_rates", SIMPLE + """
SELECT a.model AS model_a, c.model AS model_b, round(1 / (1 + pow(10, (c.rating - a.rating) / 400)), 6) AS win_rate FROM b a JOIN b c ON a.model <> c.model""")
def _(t):
    return round6(R.expected_win_rates(simple(t)))


@query("g26_expected_win_rates_vs_base", SIMPLE + """
SELECT a.model AS model_a, c.model AS model_b, round(1 / (1 + pow(10, (c.rating - a.rating) / 400)), 6) AS win_rate FROM b a JOIN b c ON a.model <> c.model WHERE c.model = 'm0'""")
def _(t):
    return round6(R.expected_win_rates(simple(t), "m0"))
