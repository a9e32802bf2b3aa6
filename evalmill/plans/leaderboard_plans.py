"""Queries over results, groups and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import exact as X
from evalmill.operators import leaderboard as L
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6

RESULTS = with_tables("ev_results")
SETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MODELS = ["m0", "m1", "m2", "m3", "m4"]
# group, dataset, metric, weight, how
TAXONOMY = [
    *[("all", d, "accuracy", 1.0, "naive_average") for d in SETS],
    *[("weighted", d, "accuracy", float(i), "weighted_average") for i, d in enumerate(SETS)],
    *[("total", d, "items", 1.0, "sum") for d in SETS[:3]],
    *[("spread", d, "accuracy", 1.0, "standard_deviation") for d in SETS],
    *[("harmonic", d, "accuracy", 1.0, "harmonic_mean") for d in SETS],
    ("broken", SETS[0], "accuracy", 1.0, "naive_average"),
    ("broken", "no such set", "accuracy", 1.0, "naive_average"),
    ("absent", "no such set", "accuracy", 1.0, "naive_average"),
]
TAX_SCHEMA = '`group` string, dataset string, metric string, weight double, how string'
TAX_SQL = "taxonomy(\"group\", dataset, metric, weight, how) AS (VALUES " + ", ".join(
    f"('{g}', '{d}', '{m}', {w}e0, '{h}')" for g, d, m, w, h in TAXONOMY
) + ")"


def taxonomy(t):
    return t.spark.createDataFrame(TAXONOMY, TAX_SCHEMA)


@query("leaderboard_end_to_end", with_tables("ev_scored") + """
, e AS (SELECT model, category AS dataset, CASE WHEN regexp_matches(prediction, '[A-D]') THEN
  CASE WHEN contains(prediction, 'answer is ') THEN regexp_extract(split_part(prediction, 'answer is ', 2), '([A-D])', 1) ELSE regexp_extract(prediction, '([A-Z])', 1) END
  ELSE prediction END AS a, gold FROM ev_scored),
r AS (SELECT model, dataset, avg(CASE WHEN a = gold THEN 100e0 ELSE 0e0 END) AS score FROM e GROUP BY model, dataset),
g AS (SELECT * FROM r UNION ALL SELECT model, 'average' AS dataset, avg(score) AS score FROM r GROUP BY model)
SELECT dataset, 'accuracy' AS metric, """ + ", ".join(
    f"coalesce(printf('%.2f', round(max(score) FILTER (model = '{m}'), 2)), '-') AS {m}" for m in MODELS
) + " FROM g GROUP BY dataset")
def _(t):
    scored = E.extract(t.ev_scored, E.answer_choice)
    rows = X.accuracy(scored.withColumnRenamed("category", "dataset"), ["model", "dataset"])
    results = rows.select("model", "dataset", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("score"))
    groups = t.spark.createDataFrame(
        [("average", d, "accuracy", 1.0, "naive_average") for d in SETS], TAX_SCHEMA
    )
    total = L.group_scores(results, groups).select(
        "model", F.col("group").alias("dataset"), F.lit("accuracy").alias("metric"), "score"
    )
    return L.pivot_models(results.unionByName(total), MODELS)


@query("d11_common_metrics", RESULTS + """
SELECT metric FROM ev_results GROUP BY metric HAVING count(DISTINCT dataset) = 5""")
def _(t):
    return L.common_metrics(t.ev_results, SETS)


@query("d11_missing_subsets", RESULTS + f""", {TAX_SQL}
SELECT m.model, "group", x.dataset FROM (SELECT DISTINCT model FROM ev_results) m, taxonomy x
WHERE NOT EXISTS (SELECT 1 FROM ev_results r WHERE r.model = m.model AND r.dataset = x.dataset)""")
def _(t):
    return L.missing_subsets(t.ev_results, taxonomy(t))


@query("g27_result_tidy_up", with_tables("ev_scored") + """
, r AS (SELECT model, category AS dataset, avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) AS accuracy, count(*) * 1e0 AS total, max(category) = '5-LOW' AS bad
 FROM ev_scored GROUP BY model, category)
SELECT model, dataset, 'accuracy' AS metric, round(accuracy, 6) AS score, 1 AS metric_rank FROM r WHERE NOT bad
UNION ALL SELECT model, dataset, 'total', total, 2 FROM r WHERE NOT bad""")
def _(t):
    right = F.avg(F.when(F.col("answer") == F.col("gold"), 100.0).otherwise(0.0))
    raw = t.ev_scored.groupBy("model", F.col("category").alias("dataset")).agg(
        right.alias("acc"), F.count(F.lit(1)).cast("double").alias("total")
    )
    metrics = F.when(F.col("dataset") == "5-LOW", F.create_map(F.lit("error"), F.lit("no output"))).otherwise(
        F.create_map(
            F.lit("total"), F.col("total").cast("string"),
            F.lit("accuracy"), F.col("acc").cast("string"),
            F.lit("bp"), F.lit("1.0"),
            F.lit("note"), F.lit("text"),
        )
    )
    return round6(L.tidy(raw.select("model", "dataset", metrics.alias("metrics"))))


@query("g28_group_scores", RESULTS + f""", {TAX_SQL},
j AS (SELECT r.model, x.* , r.score FROM ev_results r JOIN taxonomy x ON r.dataset = x.dataset AND r.metric = x.metric),
n AS (SELECT "group", count(*) AS wanted FROM taxonomy GROUP BY 1),
a AS (SELECT model, "group", how, count(*) AS present, CASE how WHEN 'naive_average' THEN avg(score) WHEN 'weighted_average' THEN sum(score * weight) / sum(weight)
 WHEN 'sum' THEN sum(score) WHEN 'standard_deviation' THEN stddev_pop(score) ELSE count(*) / sum(1 / score) END AS score FROM j GROUP BY model, "group", how)
SELECT model, "group", CASE WHEN present = wanted THEN how ELSE 'error' END AS metric, CASE WHEN present = wanted THEN round(score, 6) END AS score
FROM a JOIN n USING ("group")""")
def _(t):
    return round6(L.group_scores(t.ev_results, taxonomy(t)))


# group, member, metric, weight, how, name
NESTED = [
    *[("urgent", d, None, None, "naive_average", None) for d in SETS[:2]],
    *[("calm", d, None, float(i + 1), "weighted_average", None) for i, d in enumerate(SETS[2:])],
    ("all", "urgent", None, None, "naive_average", None),
    ("all", "calm", None, None, "naive_average", None),
    ("named", "urgent", "naive_average", None, "sum", "score"),
    ("named", SETS[4], "items", None, "sum", "score"),
    ("top", "all", None, None, "harmonic_mean", None),
    ("top", "named", None, None, "harmonic_mean", None),
    ("broken", SETS[0], None, None, "naive_average", None),
    ("broken", "no such set", None, None, "naive_average", None),
    ("above", "broken", None, None, "naive_average", None),
    ("above", "urgent", None, None, "naive_average", None),
    ("absent", "no such set", None, None, "naive_average", None),
]
NESTED_SCHEMA = "`group` string, member string, metric string, weight double, how string, name string"


def nested(t):
    return t.spark.createDataFrame(NESTED, NESTED_SCHEMA)


@query("g28_nested_groups", RESULTS + """
, u AS (SELECT model, metric, avg(score) AS score FROM ev_results WHERE dataset IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
w(dataset, w) AS (VALUES ('3-MEDIUM', 1), ('4-NOT SPECIFIED', 2), ('5-LOW', 3)),
c AS (SELECT model, metric, sum(score * w) / sum(w) AS score FROM ev_results JOIN w USING (dataset) GROUP BY 1, 2),
a AS (SELECT model, metric, (u.score + c.score) / 2 AS score FROM u JOIN c USING (model, metric)),
n AS (SELECT u.model, u.score + r.score AS score FROM u JOIN ev_results r ON u.model = r.model AND u.metric = 'accuracy' AND r.metric = 'items' AND r.dataset = '5-LOW'),
x AS (SELECT 'urgent' AS "group", model, metric, score, CASE metric WHEN 'accuracy' THEN 1 ELSE 2 END AS r FROM u
 UNION ALL SELECT 'urgent', model, 'naive_average', score, 3 FROM u WHERE metric = 'accuracy'
 UNION ALL SELECT 'calm', model, metric, score, CASE metric WHEN 'accuracy' THEN 1 ELSE 2 END FROM c
 UNION ALL SELECT 'calm', model, 'weighted_average', score, 3 FROM c WHERE metric = 'accuracy'
 UNION ALL SELECT 'all', model, metric, score, CASE metric WHEN 'accuracy' THEN 1 ELSE 2 END FROM a
 UNION ALL SELECT 'all', model, 'naive_average', score, 3 FROM a WHERE metric = 'accuracy'
 UNION ALL SELECT 'named', model, 'score', score, 1 FROM n
 UNION ALL SELECT 'top', model, 'harmonic_mean', 2 / (1 / a.score + 1 / n.score), 1 FROM a JOIN n USING (model) WHERE metric = 'accuracy'
 UNION ALL SELECT g, model, 'error', NULL, 1 FROM (SELECT DISTINCT model FROM u), (VALUES ('broken'), ('above')) b(g))
SELECT "group", model, metric, round(score, 6) AS score, r AS metric_rank FROM x""")
def _(t):
    rank = F.when(F.col("metric") == "accuracy", 1).otherwise(2)
    return round6(L.nested_groups(t.ev_results.withColumn("metric_rank", rank), nested(t)))


@query("g27_group_modes", """
SELECT * FROM (VALUES ('1-URGENT', 'gen'), ('2-HIGH', 'gen'), ('3-MEDIUM', 'ppl'), ('4-NOT SPECIFIED', 'll'), ('5-LOW', 'unknown'), ('urgent', 'gen'), ('calm', 'mixed'),
 ('all', 'mixed'), ('named', 'mixed'), ('top', 'mixed'), ('broken', 'mixed'), ('above', 'mixed'), ('absent', 'unknown')) x(dataset, mode)
WHERE dataset IN (SELECT DISTINCT o_orderpriority FROM orders) OR dataset NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')""")
def _(t):
    kinds = F.when(F.col("dataset") < "3", "GenInferencer").when(F.col("dataset") < "4", "my.PPLInferencer").when(F.col("dataset") < "5", "LLInferencer")
    runs = t.ev_results.select("dataset").distinct().withColumn("inferencer", kinds)
    return L.group_modes(L.run_modes(runs), nested(t))


@query("g29_leaderboard_pivot", RESULTS + """
SELECT dataset, metric, """ + ", ".join(
    f"coalesce(printf('%.2f', round(max(score) FILTER (model = '{m}'), 2)), '-') AS {m}" for m in [*MODELS, "m9"]
) + " FROM ev_results GROUP BY dataset, metric")
def _(t):
    return L.pivot_models(t.ev_results, [*MODELS, "m9"])


@query("g29_leaderboard_settings", RESULTS + """
SELECT dataset, CASE WHEN dataset <> '5-LOW' THEN substr(md5(dataset), 1, 6) ELSE '-' END AS version, metric,
CASE WHEN dataset = '5-LOW' THEN '-' WHEN dataset < '3' THEN 'gen' ELSE 'ppl' END AS mode, """ + ", ".join(
    f"coalesce(printf('%.2f', round(max(score) FILTER (model = '{m}'), 2)), '-') AS {m}" for m in MODELS
) + " FROM ev_results GROUP BY dataset, metric")
def _(t):
    version = F.substring(F.md5(F.col("dataset").cast("binary")), 1, 6)
    mode = F.when(F.col("dataset") < "3", "gen").otherwise("ppl")
    listed = t.ev_results.filter(F.col("dataset") != "5-LOW").select("dataset", version.alias("version"), mode.alias("mode")).distinct()
    return L.pivot_models(t.ev_results, MODELS, settings=listed)


@query("g29_two_level_table", RESULTS + """
, w AS (SELECT dataset, """ + ", ".join(
    f"coalesce(printf('%.2f', round(max(score) FILTER (model = '{m}' AND metric = '{k}'), 2)), '-') AS c{3 + 2 * i + j}" for i, m in enumerate(MODELS[:2]) for j, k in enumerate(["accuracy", "items"])
) + """ FROM ev_results GROUP BY dataset),
d(line, c0) AS (VALUES (2, '2-HIGH'), (3, '1-URGENT'), (4, 'no such set'))
SELECT 0 AS line, 'dataset' AS c0, 'version' AS c1, 'mode' AS c2, 'm0' AS c3, '-' AS c4, 'm1' AS c5, '-' AS c6 UNION ALL SELECT 1, '-', '-', '-', 'accuracy', 'items', 'accuracy', 'items'
UNION ALL SELECT line, c0, CASE WHEN line = 2 THEN 'v1' ELSE '-' END, CASE WHEN line = 2 THEN 'gen' ELSE '-' END, coalesce(c3, '-'), coalesce(c4, '-'), coalesce(c5, '-'), coalesce(c6, '-') FROM d LEFT JOIN w ON d.c0 = w.dataset""")
def _(t):
    settings = t.ev_results.filter("dataset = '2-HIGH'").select("dataset", F.lit("v1").alias("version"), F.lit("gen").alias("mode")).distinct()
    return L.two_level_table(t.ev_results, MODELS[:2], ["accuracy", "items"], settings, ["2-HIGH", "1-URGENT", "no such set"])


@query("g30_compression_table", RESULTS + """
, a AS (SELECT model, """ + ", ".join(
    f"round(max(score) FILTER (dataset = '{d}'), 4) AS \"{d}\"" for d in SETS
) + """ FROM ev_results WHERE metric = 'accuracy' GROUP BY model)
SELECT *, round((""" + " + ".join(f'"{d}"' for d in SETS) + ") / 5, 4) AS average FROM a")
def _(t):
    wide = L.outer_merge(t.ev_results.filter("metric = 'accuracy'"), SETS)
    return L.compression_table(L.unpivot_scores(wide, ["model"], SETS), SETS)


PROFILES = [("urgent", SETS[0]), ("urgent", SETS[1]), ("relaxed", SETS[4]), ("empty", "no such set")]


@query("g31_profile_tables", RESULTS + """
SELECT profile, dataset, model, metric, round(score, 6) AS score FROM ev_results JOIN (VALUES ('urgent', '1-URGENT'), ('urgent', '2-HIGH'),
 ('relaxed', '5-LOW'), ('empty', 'no such set')) p(profile, dataset) USING (dataset)""")
def _(t):
    return round6(L.profile_tables(t.ev_results, t.spark.createDataFrame(PROFILES, "profile string, dataset string")))


@query("g32_section_averages", RESULTS + """
SELECT section, model, round(avg(score), 6) AS score FROM ev_results JOIN (VALUES ('urgent', '1-URGENT'), ('urgent', '2-HIGH'), ('relaxed', '5-LOW')) p(section, dataset)
USING (dataset) WHERE metric = 'accuracy' GROUP BY section, model""")
def _(t):
    sections = t.spark.createDataFrame(PROFILES[:3], "section string, dataset string")
    return round6(L.section_averages(t.ev_results.filter("metric = 'accuracy'"), sections))


@query("g32_win_count", RESULTS + """
, b AS (SELECT *, score > max(score) OVER (PARTITION BY dataset, metric) - 1e-8 AS best FROM ev_results)
SELECT model, count(*) FILTER (best) AS wins FROM b GROUP BY model""")
def _(t):
    return L.win_count(t.ev_results)


@query("g33_length_summary", with_tables("ev_predictions") + """
, r AS (SELECT model, count(*) * 1e0 AS rating FROM ev_predictions GROUP BY model)
SELECT r.model, rating, round((SELECT avg(len(string_split(p.prediction, ' '))) FROM ev_predictions p WHERE p.model = r.model), 6) AS avg_tokens FROM r""")
def _(t):
    ratings = t.ev_predictions.groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("rating"))
    return round6(L.length_summary(t.ev_predictions, ratings, F.size(F.split("prediction", " "))))


@query("d10_outer_merge_scores", RESULTS + """
, p AS (SELECT model, """ + ", ".join(
    f"round(max(score) FILTER (dataset = '{d}'), 6) AS \"{d}\"" for d in SETS
) + """ FROM ev_results WHERE metric = 'accuracy' AND NOT (model = 'm3' AND dataset = '5-LOW') GROUP BY model)
SELECT * FROM p WHERE "5-LOW" IS NOT NULL""")
def _(t):
    rows = t.ev_results.filter("metric = 'accuracy' and not (model = 'm3' and dataset = '5-LOW')")
    return round6(L.outer_merge(rows, SETS))
