"""Queries over repeated samples and likelihoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import likelihood as K
from evalmill.operators import samples as S
from evalmill.operators.prompts import replicate
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6

SCORED = with_tables("ev_scored")
COUNTS = SCORED + ", c AS (SELECT model, item_id, count(*) AS n, count(*) FILTER (answer = gold) AS c FROM ev_scored GROUP BY 1, 2)\n"


def counts(t):
    rows = t.ev_scored.withColumn("right", F.col("answer") == F.col("gold"))
    return S.outcome_counts(rows, ["model"])


# binomials by gamma functions, a way of computing that differs from the operator's products
CHOOSE = "CASE WHEN {k} < 0 OR {k} > {n} THEN 0e0 ELSE round(exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))) END"


def choose(n: str, k: str) -> str:
    return CHOOSE.replace("{n}", f"({n})").replace("{k}", f"({k})")


@query("f38_pass_at_k", COUNTS + f"""
, m AS (SELECT model, """ + ", ".join(
    f"avg(CASE WHEN n >= {k} THEN 1 - {choose('n - c', str(k))} / {choose('n', str(k))} END) * 100 AS a{k}, min(n) AS lo{k}" for k in (1, 2)
) + """ FROM c GROUP BY model)
SELECT model, CASE WHEN lo1 >= 1 THEN round(a1, 6) END AS "pass@1", CASE WHEN lo2 >= 2 THEN round(a2, 6) END AS "pass@2" FROM m""")
def _(t):
    return round6(S.pass_at_k(counts(t), ["model"], [1, 2]))


@query("f38_pass_at_k_from_tests", """
WITH s AS (SELECT l_returnflag AS model, l_partkey % 200 AS item_id, l_suppkey AS sample, min(CASE WHEN l_quantity > 6 THEN 1 ELSE -1 END) > 0 AS ok FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT model, item_id, count(*) AS n, count(*) FILTER (ok) AS c FROM s GROUP BY 1, 2)
SELECT model, """ + ", ".join(f"CASE WHEN min(n) >= {k} THEN round(avg(1 - {choose('n - c', str(k))} / {choose('n', str(k))}) * 100, 6) END AS \"pass@{k}\"" for k in (1, 5, 10)) + " FROM c GROUP BY model")
def _(t):
    tests = t.lineitem.select(
        F.col("l_returnflag").alias("model"), (F.col("l_partkey") % 200).alias("item_id"), F.col("l_suppkey").alias("sample"),
        F.when(F.col("l_quantity") > 6, 1).otherwise(-1).alias("result"),
    )
    samples = S.solved(tests, ["model", "item_id", "sample"])
    return round6(S.pass_at_k(S.outcome_counts(samples, ["model"]), ["model"], [1, 5, 10]))


def tail(n: str, c: str, k: int, m: int) -> str:
    terms = " + ".join(f"{choose(c, str(i))} * {choose(f'{n} - {c}', str(k - i))}" for i in range(m, k + 1))
    return f"(({terms}) / {choose(n, str(k))})"


G_K = 4
G_SQL = ", ".join(
    [f"round(avg(CASE WHEN n >= {G_K} THEN {tail('n', 'c', G_K, m)} ELSE 0e0 END) * 100, 6) AS \"g_pass@4_{th}\"" for th, m in [(0.0, 1), (0.25, 1), (0.5, 2), (0.75, 3), (1.0, 4)]]
    + [f"round(avg(CASE WHEN n >= {G_K} THEN ({tail('n', 'c', G_K, 3)} + {tail('n', 'c', G_K, 4)}) * 2 / 4 ELSE 0e0 END) * 100, 6) AS \"mg_pass@4\""]
)


@query("f39_g_pass_at_k", """
WITH c AS (SELECT l_returnflag AS model, l_partkey % 200 AS item_id, count(*) AS n, count(*) FILTER (l_quantity > 30) AS c FROM lineitem GROUP BY 1, 2)
SELECT model, """ + G_SQL + " FROM c GROUP BY model")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"), (F.col("l_partkey") % 200).alias("item_id"), (F.col("l_quantity") > 30).alias("right")
    )
    return round6(S.g_pass_at_k(S.outcome_counts(rows, ["model"]), ["model"], G_K))


@query("f40_run_average", SCORED + """
, r AS (SELECT model, CAST(pos % 3 AS INT) AS replica, avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) AS s FROM ev_scored GROUP BY 1, 2)
SELECT model, round(avg(s), 6) AS score, 'accuracy (3 runs average)' AS metric FROM r GROUP BY model""")
def _(t):
    rows = t.ev_scored.withColumn("replica", (F.col("pos") % 3).cast("int"))
    rows = rows.withColumn("score", F.when(F.col("answer") == F.col("gold"), 100.0).otherwise(0.0))
    return round6(S.run_average(rows, ["model"], 3))


@query("f41_subdivision_scores", SCORED + """
SELECT model, coalesce(category, 'overall') AS subdivision, round(avg(CASE WHEN answer = gold THEN 1e0 ELSE 0e0 END) * 100, 6) AS score
FROM ev_scored GROUP BY GROUPING SETS ((model, category), (model))""")
def _(t):
    rows = t.ev_scored.withColumn("score", (F.col("answer") == F.col("gold")).cast("double"))
    return round6(S.subdivision_scores(rows.withColumnRenamed("category", "subdivision"), ["model"]))


@query("f42_majority_vote", SCORED + """
, c AS (SELECT item_id, answer, count(*) AS n, min(pos) AS f FROM ev_scored GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS k FROM c) SELECT item_id, answer AS vote FROM r WHERE k = 1""")
def _(t):
    return S.majority_vote(t.ev_scored, ["item_id"])


LABELS = with_tables("ev_label_scores", "ev_items")


@query("f43_min_loss_choice", LABELS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY nll, label_pos) AS k FROM ev_label_scores) SELECT item_id, label AS choice FROM r WHERE k = 1""")
def _(t):
    return K.min_loss_choice(t.ev_label_scores)


@query("f43_normalised_choice", LABELS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY nll - n_tokens, label_pos) AS k FROM ev_label_scores) SELECT item_id, label AS choice FROM r WHERE k = 1""")
def _(t):
    return K.min_loss_choice(t.ev_label_scores, norm="n_tokens")


@query("f44_max_likelihood_choice", LABELS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY -nll * n_tokens DESC, label_pos) AS k FROM ev_label_scores) SELECT item_id, label AS choice FROM r WHERE k = 1""")
def _(t):
    return K.max_likelihood_choice(t.ev_label_scores.withColumn("ll", -F.col("nll") * F.col("n_tokens")))


@query("f45_choice_probabilities", LABELS + """
, w AS (SELECT *, exp(-nll - max(-nll) OVER (PARTITION BY item_id)) AS w FROM ev_label_scores),
p AS (SELECT item_id, label_pos, w / sum(w) OVER (PARTITION BY item_id) AS p, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, label_pos) AS k FROM w)
SELECT item_id, round(max(p) FILTER (k = 1), 6) AS top_p, round(sum(p * label_pos), 6) AS mean_label, CAST(max(label_pos) FILTER (k = 1) AS INT) AS pred_label, count(*) AS n FROM p GROUP BY item_id""")
def _(t):
    rows = K.choice_probabilities(t.ev_label_scores.withColumn("logp", -F.col("nll")))
    listed = t.ev_label_scores.groupBy("item_id").agg(F.array_sort(F.collect_list("label_pos")).alias("l"))
    mean = F.aggregate(F.zip_with("prediction", "l", lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return round6(rows.join(listed, "item_id").select(
        "item_id", F.array_max("prediction").alias("top_p"), mean.alias("mean_label"), "pred_label",
        F.size("prediction").cast("bigint").alias("n"),
    ))


@query("f46_loss_ranking_accuracy", LABELS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY nll, label_pos) AS k FROM ev_label_scores)
SELECT coalesce(category, 'total') AS category, round(avg(CASE WHEN label = gold THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM r JOIN ev_items USING (item_id) WHERE k = 1 GROUP BY GROUPING SETS ((category), ())""")
def _(t):
    return round6(K.loss_ranking_accuracy(t.ev_label_scores, t.ev_items, "category"))


@query("f47_bits_per_byte", LABELS + """
, b AS (SELECT item_id, nll * n_tokens / n_bytes AS b FROM ev_label_scores),
i AS (SELECT item_id, min(b) AS lo, CASE WHEN count(*) > 1 THEN (sum(b) - min(b)) / (count(*) - 1) END AS hi FROM b GROUP BY item_id)
SELECT round(avg(lo) * 100, 6) AS correct_bpb, round(avg(hi) * 100, 6) AS incorrect_bpb FROM i""")
def _(t):
    return round6(K.bits_per_byte(t.ev_label_scores))


@query("f48_average_ppl", LABELS + """
SELECT label, round(avg(nll), 6) AS average_ppl, round(sum(nll * n_tokens) / sum(n_tokens), 6) AS token_weighted_ppl FROM ev_label_scores GROUP BY label""")
def _(t):
    return round6(K.average_ppl(t.ev_label_scores, ["label"]))


LOSSES = with_tables("ev_token_losses")


@query("f49_min_k_percent", LOSSES + """
, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY loss DESC, pos) AS k, count(*) OVER (PARTITION BY seq_id) AS n FROM ev_token_losses)
SELECT seq_id, round(-avg(loss), 6) AS min_k FROM r WHERE k <= greatest(n * 20 // 100, 1) GROUP BY seq_id""")
def _(t):
    return round6(K.min_k_percent(t.ev_token_losses, 20))


@query("f49_min_k_percent_mean", LOSSES + """
, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY loss DESC, pos) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM ev_token_losses),
s AS (SELECT event_type, -avg(loss) AS m FROM r WHERE k <= greatest(n * 20 // 100, 1) GROUP BY event_type)
SELECT round(avg(m), 6) AS min_k FROM s""")
def _(t):
    return round6(K.min_k_percent(t.ev_token_losses, 20, ["event_type"]).agg(F.avg("min_k").alias("min_k")))


@query("f50_bits_per_character", LOSSES + """
SELECT round(sum(loss) / ((SELECT sum(n_chars) FROM documents) * ln(2)), 6) AS bpc FROM ev_token_losses""")
def _(t):
    return round6(K.bits_per_character(t.ev_token_losses, t.documents))


@query("f51_sliding_windows", LOSSES + """
, g AS (SELECT loss, row_number() OVER (ORDER BY seq_id, pos) - 1 AS p, count(*) OVER () AS n FROM ev_token_losses),
w AS (SELECT i, n, i * 100 AS b, least(i * 100 + 700, n) AS e, CASE WHEN i = 0 THEN 0 ELSE least((i - 1) * 100 + 700, n) END AS prev FROM (SELECT any_value(n) AS n FROM g), LATERAL (SELECT unnest(range(0, CAST(floor((n - 700) / 100e0 + 1) AS BIGINT))) AS i) z)
SELECT i AS "window", count(*) AS scored, round(sum(loss), 4) AS loss FROM w JOIN g ON p >= prev AND p < e GROUP BY i""")
def _(t):
    return K.sliding_windows(t.ev_token_losses, 700, 100).withColumn("loss", F.round("loss", 4))


DRAWS = """WITH d AS (SELECT l_partkey % 300 AS item_id, l_linenumber AS draw, CAST(l_suppkey % 2 AS INT) AS batch, l_quantity AS ce, (1 + l_orderkey % 9) / 10e0 AS ratio FROM lineitem),
r AS (SELECT item_id, draw, sum(ce / ratio) / count(DISTINCT batch) AS l FROM d GROUP BY 1, 2)
SELECT item_id, round(-avg(l), 6) AS ll, round(stddev_samp(l) / sqrt(count(*)), 6) AS se, count(*) AS draws FROM r GROUP BY item_id"""


@query("f52_monte_carlo_ll", DRAWS)
def _(t):
    rows = t.lineitem.select(
        (F.col("l_partkey") % 300).alias("item_id"), F.col("l_linenumber").alias("draw"), (F.col("l_suppkey") % 2).alias("batch"),
        F.col("l_quantity").alias("ce"), ((1 + F.col("l_orderkey") % 9) / 10).alias("ratio"),
    )
    return round6(K.monte_carlo_ll(rows))


@query("f53_guided_log_probs", LABELS + """
, g AS (SELECT item_id, label AS token, -n_bytes / 50 + 2.5e0 * (-nll - (-n_bytes / 50)) AS g FROM ev_label_scores),
m AS (SELECT *, max(g) OVER (PARTITION BY item_id) AS m FROM g)
SELECT item_id, token, round(g - m - ln(sum(exp(g - m)) OVER (PARTITION BY item_id)), 6) AS logp FROM m""")
def _(t):
    rows = t.ev_label_scores.withColumnRenamed("label", "token")
    cond = rows.select("item_id", "token", (-F.col("nll")).alias("logit"))
    uncond = rows.select("item_id", "token", (-F.col("n_bytes") / 50).alias("logit"))
    return round6(K.guided_log_probs(cond, uncond, 1.5, keys=("item_id",)))


@query("f54_split_gaps", """
WITH s AS (SELECT lang, CASE WHEN source < 'm' THEN 'train' WHEN doc_id % 2 = 0 THEN 'test' ELSE 'ref' END AS split, ln(n_chars) AS nll FROM documents),
m AS (SELECT lang, avg(nll) FILTER (split = 'train') AS train, avg(nll) FILTER (split = 'test') AS test, avg(nll) FILTER (split = 'ref') AS ref FROM s GROUP BY lang)
SELECT lang, round(train, 6) AS train, round(test, 6) AS test, round(ref, 6) AS ref, round(test - train, 6) AS test_minus_train, round(test - ref, 6) AS test_minus_ref FROM m""")
def _(t):
    split = F.when(F.col("source") < "m", "train").when(F.col("doc_id") % 2 == 0, "test").otherwise("ref")
    return round6(K.split_gaps(t.documents.select("lang", split.alias("split"), F.log("n_chars").alias("nll")), ["lang"]))


@query("c9_entropy_choice", """
WITH l AS (SELECT l_orderkey AS test_id, l_linenumber AS subset_id, l_suppkey AS label, max(l_quantity / 10) AS loss FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, -loss - max(-loss) OVER (PARTITION BY test_id, subset_id) AS x FROM l),
h AS (SELECT test_id, subset_id, sum(x * exp(x)) / sum(exp(x)) - ln(sum(exp(x))) AS h FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(h, 12) DESC, subset_id) AS k FROM h)
SELECT test_id, subset_id, round(h, 6) + 0e0 AS neg_entropy FROM r WHERE k = 1""")
def _(t):
    rows = t.lineitem.groupBy(
        F.col("l_orderkey").alias("test_id"), F.col("l_linenumber").alias("subset_id"), F.col("l_suppkey").alias("label")
    ).agg(F.max(F.col("l_quantity") / 10).alias("loss"))
    return round6(K.entropy_choice(rows))


@query("b2_replicated_scores", """
SELECT o_orderstatus AS difficulty, CAST(r AS INT) AS replica, count(*) AS n FROM orders, range(3) x(r) GROUP BY 1, 2""")
def _(t):
    return replicate(t.ev_items, 3).groupBy("difficulty", "replica").agg(F.count(F.lit(1)).alias("n"))
