"""Queries over judge verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import judge as J
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6

SCORED = with_tables("ev_scored")
JUDGED = with_tables("ev_judgements")
ARENA = r"nullif(regexp_extract(verdict_text, '\[\[([AB<>=]+)\]\]', 1), '')"
# the arena verdicts folded to A, B, C (draw) or null
ABC_SQL = f"CASE WHEN {ARENA} IN ('A>>B', 'A>B') THEN 'A' WHEN {ARENA} IN ('B>>A', 'B>A') THEN 'B' WHEN {ARENA} = 'A=B' THEN 'C' END"


def abc(t):
    v = E.verdict("arena")(F.col("verdict_text"))
    letter = F.when(v.isin("A>>B", "A>B"), "A").when(v.isin("B>>A", "B>A"), "B").when(v == "A=B", "C")
    return t.ev_judgements.withColumn("verdict", letter)


@query("g1_grade_summary", SCORED + """
, c AS (SELECT model, count(*) AS n, count(*) FILTER (answer = 'A') AS r, count(*) FILTER (answer = 'B') AS w FROM ev_scored GROUP BY model),
s AS (SELECT *, r * 1e0 / n AS a, r * 1e0 / (r + w) AS g FROM c)
SELECT model, round(a * 100, 6) AS accuracy, round(g * 100, 6) AS accuracy_given_attempted, round(2 * g * a / (g + a), 6) AS f1, round((r + w) * 100e0 / n, 6) AS attempted_ratio,
 r AS correct_count, w AS incorrect_count, n - r - w AS not_attempted_count FROM s""")
def _(t):
    return round6(J.grade_summary(t.ev_scored, ["model"], "answer"))


CASCADE = SCORED + """
, r AS (SELECT model, item_id, bool_or(answer = gold) AS ok, min(difficulty) AS d FROM ev_scored GROUP BY 1, 2),
j AS (SELECT *, d = 'F' AND item_id % 2 = 0 AS jok FROM r)
"""


def cascaded(t, parallel):
    ruled = t.ev_scored.groupBy("model", "item_id").agg(F.max(F.col("answer") == F.col("gold")).alias("right"), F.min("difficulty").alias("d"))
    text = F.when((F.col("d") == "F") & (F.col("item_id") % 2 == 0), " correct, fine").otherwise("B")
    judged = ruled.select("model", "item_id", text.alias("judge_text"))
    return round6(J.cascade(ruled.drop("d"), judged, ["model"], ["model", "item_id"], parallel))


@query("g2_cascade", CASCADE + """
SELECT model, round(avg(CASE WHEN ok THEN 100e0 ELSE 0e0 END), 6) AS initial_accuracy, round(count(*) FILTER (NOT ok AND jok) * 100e0 / count(*) FILTER (NOT ok), 6) AS judge_accuracy,
 count(*) FILTER (NOT ok) AS judged, round(avg(CASE WHEN ok OR jok THEN 100e0 ELSE 0e0 END), 6) AS final_accuracy FROM j GROUP BY model""")
def _(t):
    return cascaded(t, False)


@query("g2_cascade_parallel", CASCADE + """
SELECT model, round(avg(CASE WHEN ok THEN 100e0 ELSE 0e0 END), 6) AS initial_accuracy, round(count(*) FILTER (jok) * 100e0 / count(*), 6) AS judge_accuracy,
 count(*) AS judged, round(avg(CASE WHEN ok OR jok THEN 100e0 ELSE 0e0 END), 6) AS final_accuracy FROM j GROUP BY model""")
def _(t):
    return cascaded(t, True)


RUBRIC = """WITH d AS (SELECT l_returnflag AS model, l_orderkey AS item_id, CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity ELSE l_quantity END AS points, l_partkey % 2 = 0 AS met FROM lineitem),
s AS (SELECT model, item_id, CASE WHEN sum(points) FILTER (points > 0) > 0 THEN coalesce(sum(points) FILTER (met), 0) / sum(points) FILTER (points > 0) END AS score FROM d GROUP BY 1, 2)
"""


def rubric(t):
    return J.rubric_scores(
        t.lineitem.select(
            F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("item_id"),
            F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("points"),
            (F.col("l_partkey") % 2 == 0).alias("criteria_met"),
        ),
        ["model"],
    )


@query("g3_rubric_scores", RUBRIC + "SELECT model, item_id, round(score, 6) AS score FROM s")
def _(t):
    return round6(rubric(t))


@query("g3_rubric_summary", RUBRIC + "SELECT model, round(greatest(least(avg(score), 1e0), 0e0), 6) AS score, count(score) AS n_samples FROM s GROUP BY model")
def _(t):
    return round6(J.rubric_summary(rubric(t), ["model"]))


@query("g3_bootstrap_std")
def _(t):
    return J.bootstrap_std(rubric(t), ["model"], "item_id", "score", rounds=200)


WEIGHTS = [("A", 0, 30.0), ("A", 1, 70.0), ("R", 0, 50.0), ("R", 1, 50.0), ("N", 0, 90.0), ("N", 1, 10.0)]


@query("g4_weighted_checklist", """
WITH w(k, a, b) AS (VALUES ('A', 30e0, 70e0), ('R', 50e0, 50e0), ('N', 90e0, 10e0))
SELECT l_linestatus AS model, round(avg((a * l_discount * 10 + b * l_quantity / 50 - 75) * 4), 6) AS overall_score FROM lineitem JOIN w ON k = l_returnflag WHERE l_partkey % 7 <> 0 GROUP BY 1""")
def _(t):
    scores = F.when(F.col("l_partkey") % 7 != 0, F.array(F.col("l_discount") * 10, F.col("l_quantity") / 50))
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("model"), F.monotonically_increasing_id().alias("item_id"), F.col("l_returnflag").alias("subcategory"), scores.alias("scores")
    )
    weights = t.spark.createDataFrame(WEIGHTS, "subcategory string, pos int, weight double")
    return round6(J.weighted_checklist(rows, weights, ["model"]))


@query("g5_capability_means", JUDGED + """
SELECT judge, coalesce(capability, 'total') AS capability, round(avg(difficulty_points), 2) AS score FROM ev_judgements GROUP BY GROUPING SETS ((judge, capability), (judge))""")
def _(t):
    return round6(J.capability_means(t.ev_judgements, ["judge"], score="difficulty_points"))


TAXONOMY = {"returned": ["R-O", "R-F"], "kept": ["A-O", "A-F", "N-O"]}
TAX_SQL = "CASE WHEN capability IN ('R-O', 'R-F') THEN 'returned' WHEN capability IN ('A-O', 'A-F', 'N-O') THEN 'kept' END"


def rollup_sql(source: str) -> str:
    return f""", l AS ({source}), m AS (SELECT judge, {TAX_SQL} AS c, avg(score) AS score FROM l WHERE {TAX_SQL} IS NOT NULL GROUP BY 1, 2)
SELECT judge, 'capability' AS level, capability AS name, round(score, 6) AS score FROM l UNION ALL SELECT judge, 'category', c, round(score, 6) FROM m UNION ALL SELECT judge, 'total', 'total', round(avg(score), 6) FROM m GROUP BY judge"""


@query("g6_mean_of_means", JUDGED + rollup_sql("SELECT judge, capability, avg(difficulty_points) AS score FROM ev_judgements GROUP BY 1, 2"))
def _(t):
    return round6(J.mean_of_means(t.ev_judgements, TAXONOMY, ["judge"], score="difficulty_points"))


@query("g7_dimension_means", """
SELECT l_returnflag AS model, k AS dimension, round(avg(CASE k WHEN 'clarity' THEN l_quantity ELSE l_tax * 100 END), 6) AS score FROM lineitem, (VALUES ('clarity'), ('depth')) x(k)
WHERE k = 'clarity' OR l_partkey % 2 = 0 GROUP BY 1, 2""")
def _(t):
    both = F.create_map(F.lit("clarity"), F.col("l_quantity"), F.lit("depth"), F.col("l_tax") * 100)
    one = F.create_map(F.lit("clarity"), F.col("l_quantity"))
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.when(F.col("l_partkey") % 2 == 0, both).otherwise(one).alias("ratings"))
    return round6(J.dimension_means(rows, ["model"]))


@query("g8_worst_turn", """
WITH d AS (SELECT l_linestatus AS model, l_returnflag AS task, l_orderkey, min(l_quantity) AS s FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT model, task, avg(s) AS s FROM d GROUP BY 1, 2)
SELECT model, task, round(s, 6) AS score FROM t UNION ALL SELECT model, 'average', round(avg(s), 6) FROM t GROUP BY model""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("task"), F.col("l_orderkey").alias("multi_id"), F.col("l_quantity").alias("score")
    )
    return round6(J.worst_turn(rows, ["model"]))


@query("g9_surviving_rounds", """
WITH l AS (SELECT 'all' AS judge, l_returnflag || '_' || l_linestatus AS capability, avg((l_linenumber + 7 - l_partkey % 7) / (l_linenumber + 7e0)) AS score FROM lineitem GROUP BY 2),
m AS (SELECT judge, CASE WHEN capability LIKE 'R%' THEN 'returned' ELSE 'kept' END AS c, avg(score) AS score FROM l GROUP BY 1, 2)
SELECT judge, 'capability' AS level, capability AS name, round(score, 6) AS score FROM l UNION ALL SELECT judge, 'category', c, round(score, 6) FROM m UNION ALL SELECT judge, 'total', 'total', round(avg(score), 6) FROM m GROUP BY judge""")
def _(t):
    rows = t.lineitem.select(
        F.lit("all").alias("judge"), F.col("l_returnflag").alias("capability"), F.col("l_linestatus").alias("language"),
        (F.col("l_linenumber") + 7).alias("rounds"), (F.col("l_partkey") % 7).alias("flagged"),
    )
    taxonomy = {"returned": ["R_O", "R_F"], "kept": ["A_O", "A_F", "N_O", "N_F"]}
    return round6(J.surviving_rounds(rows, taxonomy, ["judge"]))


LEVEL_SQL = ", ".join(
    f"round(coalesce(sum(CASE WHEN lv = {i} AND hard >= 0 THEN {c} END), 0e0) / (count(*) // 5 - count(*) FILTER (lv = {i} AND hard < 0)), 6) AS {n}_L{i}"
    for i in range(1, 6) for n, c in (("HSR", "hard"), ("SSR", "soft"))
)


@query("g10_satisfaction_by_level", f"""
WITH d AS (SELECT l_returnflag AS model, 1 + l_partkey % 5 AS lv, CASE WHEN l_suppkey % 11 = 0 THEN -1e0 WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END AS hard, l_quantity / 50 AS soft FROM lineitem),
s AS (SELECT model, {LEVEL_SQL.replace('round(', '(').replace(', 6)', ')')} FROM d GROUP BY model)
SELECT model, """ + ", ".join(f"round({n}_L{i}, 6) AS {n}_L{i}" for i in range(1, 6) for n in ("HSR", "SSR")) + ", " + ", ".join(
    f"round(({' + '.join(f'{n}_L{i}' for i in range(1, 6))}) / 5, 6) AS {n}_AVG" for n in ("HSR", "SSR")
) + " FROM s")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"), (1 + F.col("l_partkey") % 5).alias("level"),
        F.when(F.col("l_suppkey") % 11 == 0, -1.0).when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("hard"), (F.col("l_quantity") / 50).alias("soft"),
    )
    return round6(J.satisfaction_by_level(rows, ["model"]))


def with_base(t):
    rows = abc(t).filter("model_a = 'm0' or model_b = 'm0'")
    return rows.withColumn("other", F.when(F.col("model_a") == "m0", F.col("model_b")).otherwise(F.col("model_a")))


BASED = JUDGED + f""", v AS (SELECT *, {ABC_SQL} AS verdict, {ARENA} AS arena, CASE WHEN model_a = 'm0' THEN model_b ELSE model_a END AS other FROM ev_judgements WHERE model_a = 'm0' OR model_b = 'm0'),
w AS (SELECT *, CASE WHEN verdict = 'C' THEN NULL WHEN (verdict = 'A') = (model_a = 'm0') THEN 'base' ELSE 'other' END AS winner FROM v WHERE verdict IS NOT NULL)
"""


@query("g11_win_rates", BASED + """
SELECT judge, other, coalesce(capability, 'total') AS capability, round(avg(CASE WHEN winner = 'base' THEN 1e0 ELSE 0e0 END) * 100, 2) AS base_win, round(avg(CASE WHEN winner = 'other' THEN 1e0 ELSE 0e0 END) * 100, 2) AS other_win
FROM w GROUP BY GROUPING SETS ((judge, other, capability), (judge, other))""")
def _(t):
    return round6(J.win_rates(with_base(t), "m0", ["judge", "other"]))


@query("g11_win_rates_half_add", BASED + """
SELECT judge, other, coalesce(capability, 'total') AS capability, round(avg(CASE WHEN winner = 'base' THEN 1e0 WHEN winner IS NULL THEN 0.5e0 ELSE 0e0 END) * 100, 2) AS base_win, round(avg(CASE WHEN winner = 'other' THEN 1e0 WHEN winner IS NULL THEN 0.5e0 ELSE 0e0 END) * 100, 2) AS other_win
FROM w GROUP BY GROUPING SETS ((judge, other, capability), (judge, other))""")
def _(t):
    return round6(J.win_rates(with_base(t), "m0", ["judge", "other"], half_add=True))


@query("g12_win_both_ways", BASED + """
, n AS (SELECT judge, other, unnest(list_distinct([capability, split_part(capability, '-', 1)])) AS capability, winner FROM w),
c AS (SELECT judge, other, capability, count(*) AS n, count(*) FILTER (winner = 'base') AS w1, count(*) FILTER (winner = 'other') AS w2, count(*) FILTER (winner IS NULL) AS d FROM n GROUP BY 1, 2, 3)
SELECT judge, other, capability, CASE WHEN w1 > 0 THEN round((w1 + d) * 1e0 / n * 100, 2) ELSE 0e0 END AS win_both_1, CASE WHEN w2 > 0 THEN round((w2 + d) * 1e0 / n * 100, 2) ELSE 0e0 END AS win_both_2,
 CASE WHEN w1 > 0 THEN round(w1 * 1e0 / n * 100, 2) ELSE 0e0 END AS half_draw_1, CASE WHEN w2 > 0 THEN round(w2 * 1e0 / n * 100, 2) ELSE 0e0 END AS half_draw_2 FROM c""")
def _(t):
    return round6(J.win_both_ways(with_base(t), "m0", ["judge", "other"]))


MARGIN = "CASE arena WHEN 'A>>B' THEN 1e0 WHEN 'A>B' THEN 0.5e0 WHEN 'A=B' THEN 0e0 WHEN 'B>A' THEN -0.5e0 WHEN 'B>>A' THEN -1e0 END * CASE WHEN model_a = 'm0' THEN -1 ELSE 1 END"


@query("g13_margin_scores", BASED + f"""
, m AS (SELECT judge, area, CAST(difficulty_points % 3 AS INT) AS d, {MARGIN} AS m FROM v WHERE arena IS NOT NULL)
SELECT judge, CASE WHEN grouping(area) = 1 THEN 'Average_score' ELSE area || '_' || CAST(d AS VARCHAR) END AS metric, round(avg(m) * 100, 3) + 0e0 AS score FROM m GROUP BY GROUPING SETS ((judge, area, d), (judge))""")
def _(t):
    rows = with_base(t).withColumn("verdict", E.verdict("arena")(F.col("verdict_text"))).withColumn("d", F.col("difficulty_points") % 3)
    return round6(J.margin_scores(rows, "m0", ["judge"], category="area", difficulty="d"))


@query("g14_tag_margins", BASED + f"""
, m AS (SELECT judge, unnest([area, CASE WHEN difficulty_points % 2 = 0 THEN 'x' ELSE 'y' END]) AS tag, {MARGIN} AS m FROM v WHERE arena IS NOT NULL),
g AS (SELECT judge, CASE tag WHEN 'A' THEN 'letters' WHEN 'N' THEN 'letters' WHEN 'R' THEN 'returned' WHEN 'x' THEN 'even' END AS g, round(avg(m) * 100, 2) AS score FROM m WHERE tag <> 'y' GROUP BY 1, 2)
SELECT judge, g AS "group", score FROM g UNION ALL SELECT judge, 'average', round(avg(score), 6) FROM g GROUP BY judge""")
def _(t):
    tags = F.array("area", F.when(F.col("difficulty_points") % 2 == 0, "x").otherwise("y"))
    rows = with_base(t).withColumn("verdict", E.verdict("arena")(F.col("verdict_text"))).withColumn("tags", tags)
    groups = {"A": "letters", "N": "letters", "R": "returned", "x": "even"}
    return round6(J.tag_margins(rows, groups, ["m0"], ["judge"]))


@query("g15_swapped_double_score", JUDGED + f"""
, v AS (SELECT judge, CASE {ABC_SQL} WHEN 'C' THEN 'tie' ELSE coalesce({ABC_SQL}, 'error') END AS v, item_id % 2 = 0 AS swapped FROM ev_judgements)
SELECT judge, round(sum(CASE WHEN v = CASE WHEN swapped THEN 'B' ELSE 'A' END THEN 1e0 WHEN v = 'tie' THEN 0.5e0 ELSE 0e0 END) FILTER (v <> 'error') / count(*) FILTER (v <> 'error') * 100, 6) AS score FROM v GROUP BY judge""")
def _(t):
    v = F.when(F.col("verdict") == "C", "tie").otherwise(F.coalesce("verdict", F.lit("error")))
    rows = abc(t).withColumn("verdict", v).withColumn("swapped", F.col("item_id") % 2 == 0)
    return round6(J.swapped_double_score(rows, ["judge"]))


@query("g16_position_bias", """
WITH d AS (SELECT l_returnflag AS judge, l_partkey AS q, l_orderkey * 10 + l_linenumber AS o, min(substr('ABC', CAST(l_suppkey % 3 AS INT) + 1, 1)) AS v FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT judge, q, min(o) AS o, arg_min(v, o) AS v FROM d GROUP BY 1, 2)
SELECT judge, count(*) FILTER (d.o > f.o AND d.v = f.v AND d.v <> 'C') AS position_bias FROM d JOIN f USING (judge, q) GROUP BY judge""")
def _(t):
    rows = t.lineitem.groupBy(
        F.col("l_returnflag").alias("judge"), F.col("l_partkey").alias("question"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen")
    ).agg(F.min(F.substr(F.lit("ABC"), (F.col("l_suppkey") % 3).cast("int") + 1, F.lit(1))).alias("verdict"))
    return J.position_bias(rows, ["judge"], ["question"], "seen")


@query("g17_judge_accuracy", SCORED + """
SELECT model, round(avg(CASE WHEN pos % 5 <> 0 AND answer = gold THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM ev_scored GROUP BY model""")
def _(t):
    said = F.concat(F.lit('{"Choice": "Model '), "answer", F.lit('", "why": "x"}'))
    rows = t.ev_scored.withColumn("judge_text", F.when(F.col("pos") % 5 == 0, F.col("answer")).otherwise(said))
    return round6(J.judge_accuracy(rows, ["model"]))


@query("g18_judge_rank_divergence", JUDGED + """
, c AS (SELECT judge, model_a, model_b, CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS choice, CASE WHEN difficulty_points % 2 = 0 THEN 'A' ELSE 'B' END AS gold FROM ev_judgements WHERE item_id % 7 <> 0),
a AS (SELECT judge, avg(CASE WHEN choice = gold THEN 100e0 ELSE 0e0 END) AS acc FROM c GROUP BY judge),
s AS (SELECT judge, model, count(*) AS s FROM (SELECT judge, CASE WHEN choice = 'A' THEN model_a ELSE model_b END AS model FROM c) WHERE model <> 'm6' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY s DESC, model) AS r FROM s),
f AS (SELECT model, sc, row_number() OVER (ORDER BY sc DESC, model) AS r FROM (VALUES ('m0', 2300), ('m1', 2100), ('m2', 2100), ('m3', 2500), ('m4', 1900), ('m5', 2000)) x(model, sc)),
d AS (SELECT judge, abs(k.r - f.r) AS dr, abs(s - sc) AS ds FROM k JOIN f USING (model)),
z AS (SELECT judge, sum(dr) AS dr, sum(ds) AS ds, max(ds) AS mx, count(*) AS m FROM d GROUP BY judge)
SELECT judge, round(acc, 6) AS accuracy, CAST(dr AS BIGINT) AS rank_diff, CAST(ds AS BIGINT) AS score_diff, round((dr * 1e0 / (m - 1) + ds * 1e0 / mx) / m * 100, 6) AS normalized_diff,
 round((acc - (dr * 1e0 / (m - 1) + ds * 1e0 / mx) / m * 100 + 100) / 2, 6) AS final_score FROM z JOIN a USING (judge)""")
def _(t):
    choice = F.when(F.col("item_id") % 2 == 0, "A").otherwise("B")
    text = F.when(F.col("item_id") % 7 == 0, "no answer").otherwise(F.concat(F.lit('{"winner": "C"} so "winner": "'), choice, F.lit('"')))
    rows = t.ev_judgements.withColumn("judge_text", text).withColumn("gold", F.when(F.col("difficulty_points") % 2 == 0, "A").otherwise("B"))
    reference = t.spark.createDataFrame(
        [("m0", 2300), ("m1", 2100), ("m2", 2100), ("m3", 2500), ("m4", 1900), ("m5", 2000)], "model string, ref_score bigint"
    )
    return round6(J.judge_rank_divergence(rows, reference, ["judge"], skip=["m6"]))


@query("g19_listwise_rank_sum", """
SELECT l_returnflag AS judge, m AS model, CAST(sum(CASE m WHEN 'm0' THEN 1 + l_partkey % 3 WHEN 'm1' THEN 1 + (l_partkey + 1) % 3 ELSE 1 + (l_partkey + 2) % 3 END) AS BIGINT) AS rank_sum
FROM lineitem, (VALUES ('m0'), ('m1'), ('m2')) x(m) GROUP BY 1, 2""")
def _(t):
    p = F.col("l_partkey")
    rows = t.lineitem.select(F.col("l_returnflag").alias("judge"), F.concat_ws(" > ", 1 + p % 3, 1 + (p + 1) % 3, 1 + (p + 2) % 3).alias("order"))
    return J.listwise_rank_sum(rows, ["m0", "m1", "m2"], ["judge"])


@query("g20_battles_from_verdicts", JUDGED + f"""
, a AS (SELECT *, {ARENA} AS v FROM ev_judgements)
SELECT judge, item_id, model_a, model_b, CASE WHEN v IN ('A>>B', 'A>B') THEN 'model_a' WHEN v = 'A=B' THEN 'tie' ELSE 'model_b' END AS winner, CASE WHEN v IN ('A>>B', 'B>>A') THEN 3 ELSE 1 END AS weight FROM a WHERE v IS NOT NULL""")
def _(t):
    return J.battles_from_verdicts(t.ev_judgements).select("judge", "item_id", "model_a", "model_b", "winner", "weight")


AGREE = """WITH d AS (SELECT l_returnflag AS dataset, 'm' || CAST(l_suppkey % 7 AS VARCHAR) AS test_model, l_linenumber % 2 = 0 AS swap, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 5 - 2 AS INT) END AS judge_score,
 CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST((l_partkey + l_linenumber % 2) % 5 - 2 AS INT) END AS meta_score FROM lineitem),
p AS (SELECT dataset, test_model, count(*) FILTER (judge_score = meta_score) AS ok, count(*) AS n, CAST(sum(meta_score * CASE WHEN swap THEN -1 ELSE 1 END) AS DOUBLE) AS m, CAST(coalesce(sum(judge_score * CASE WHEN swap THEN -1 ELSE 1 END), 0) AS DOUBLE) AS s
 FROM d WHERE meta_score IS NOT NULL GROUP BY 1, 2),
a AS (SELECT dataset, round(sum(ok) * 1e0 / sum(n), 3) AS accuracy, round(corr(m, s), 3) AS corr FROM p GROUP BY dataset)
"""


def agreement(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = t.lineitem.select(
        F.lit("j").alias("judge"), F.col("l_returnflag").alias("dataset"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("test_model"),
        (n % 2 == 0).alias("swap"), F.when(p % 11 != 0, (p % 5 - 2).cast("int")).alias("judge_score"),
        F.when(p % 13 != 0, ((p + n % 2) % 5 - 2).cast("int")).alias("meta_score"),
    )
    return J.judge_agreement(rows, ["judge"])


@query("g34_judge_agreement", AGREE + "SELECT 'j' AS judge, dataset, accuracy, corr FROM a")
def _(t):
    return agreement(t)


@query("g34_overall_agreement", """
SELECT 'j' AS judge, round(avg(CASE WHEN l_linenumber % 3 = 0 THEN 1e0 ELSE 0e0 END), 3) AS accuracy, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0""")
def _(t):
    meta = F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber") % 3)
    rows = t.lineitem.select(F.lit("j").alias("judge"), meta.alias("meta_score"), F.lit(0).alias("judge_score"))
    return J.overall_agreement(rows, ["judge"])


@query("g34_average_agreement", AGREE + "SELECT 'j' AS judge, round(avg(corr), 3) AS avg_corr FROM a")
def _(t):
    return J.average_agreement(agreement(t), ["judge"])
