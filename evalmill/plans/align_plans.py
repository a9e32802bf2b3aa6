"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import align as A
from evalmill.operators.ratings import MAX_MODELS
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6

BOTH = with_tables("ev_predictions", "ev_items")
SCORED = with_tables("ev_scored")


@query("a6_check_complete", BOTH + """
, h AS (SELECT DISTINCT model, item_id FROM ev_predictions), n AS (SELECT count(*) AS n FROM ev_items)
SELECT model, n - count(i.item_id) AS missing, count(*) FILTER (i.item_id IS NULL) AS extra, n = count(i.item_id) AND count(*) FILTER (i.item_id IS NULL) = 0 AS complete
FROM h LEFT JOIN ev_items i USING (item_id), n GROUP BY model, n""")
def _(t):
    return A.check_complete(t.ev_predictions, t.ev_items)


@query("a6_unmatched_ids", BOTH + """
SELECT item_id, 'missing' AS state FROM (SELECT item_id FROM ev_items EXCEPT SELECT item_id FROM ev_predictions)
UNION ALL SELECT item_id, 'extra' FROM (SELECT item_id FROM ev_predictions EXCEPT SELECT item_id FROM ev_items)""")
def _(t):
    return A.unmatched_ids(t.ev_predictions, t.ev_items)


@query("d1_align", SCORED + "SELECT model, item_id, pos, answer, gold FROM ev_scored")
def _(t):
    return A.align(t.ev_predictions, t.ev_items).select("model", "item_id", "pos", "answer", "gold")


@query("d2_tag_contamination", """
SELECT doc_id, coalesce(CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'input-and-label contamination' WHEN quality = 0 THEN 'input contamination' ELSE 'clean' END, 'not labeled') AS is_clean
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    return A.tag_contamination(t.documents.select("doc_id"), contamination_tags(t), "doc_id")


def contamination_tags(t):
    tag = F.when(F.col("toxic") == 1, "input-and-label contamination").when(F.col("quality") == 0, "input contamination")
    return t.labels.select("doc_id", tag.otherwise("clean").alias("is_clean"))


@query("d3_model_pairs_all", BOTH + """
, m AS (SELECT DISTINCT model FROM ev_predictions) SELECT a.model AS model_a, b.model AS model_b FROM m a, m b WHERE a.model < b.model""")
def _(t):
    return A.model_pairs(t.ev_predictions.select("model").distinct())


@query("d3_model_pairs_base", BOTH + """
, m AS (SELECT DISTINCT model FROM ev_predictions) SELECT a.model AS model_a, b.model AS model_b FROM m a, m b WHERE a.model IN ('m0', 'm1') AND a.model <> b.model""")
def _(t):
    return A.model_pairs(t.ev_predictions.select("model").distinct(), "m2n", ["m0", "m1"])


@query("d4_dedup_unordered_pairs", """
WITH p AS (SELECT 'm' || CAST(l_suppkey % 7 AS VARCHAR) AS a, 'm' || CAST(l_partkey % 7 AS VARCHAR) AS b, l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS o FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7)
SELECT arg_min(a, o) AS model_a, arg_min(b, o) AS model_b, min(o) AS seen FROM p GROUP BY least(a, b), greatest(a, b)""")
def _(t):
    pairs = t.lineitem.select(
        F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("model_a"),
        F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("model_b"),
        (F.col("l_orderkey") * 10000000000 + F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("seen"),
    )
    return A.dedup_unordered_pairs(pairs, "seen")


ONE = ", one AS (SELECT model, item_id, arg_min(answer, pos) AS answer FROM ev_predictions GROUP BY model, item_id)"


def one_answer(t):
    return t.ev_predictions.groupBy("model", "item_id").agg(F.min_by("answer", "pos").alias("answer"))


PAIRED = ONE + """
, pr AS (SELECT a.item_id, a.model AS model_a, b.model AS model_b, a.answer AS answer_a, b.answer AS answer_b FROM one a JOIN one b ON a.item_id = b.item_id AND a.model < b.model)
"""


@query("d5_pair_predictions", BOTH + PAIRED + "SELECT * FROM pr")
def _(t):
    pairs = A.model_pairs(t.ev_predictions.select("model").distinct())
    return A.pair_predictions(one_answer(t), pairs)


@query("d6_drop_identical_pairs", BOTH + PAIRED + "SELECT * FROM pr WHERE answer_a <> answer_b")
def _(t):
    pairs = A.model_pairs(t.ev_predictions.select("model").distinct())
    return A.drop_identical_pairs(A.pair_predictions(one_answer(t), pairs))


@query("d7_match_baseline", """
SELECT o_orderkey, o_custkey AS gt, o_orderstatus AS prediction, c_name AS baseline_prediction FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(t):
    preds = t.orders.select("o_orderkey", F.col("o_custkey").alias("gt"), F.col("o_orderstatus").alias("prediction"))
    baseline = t.customer.select(F.col("c_custkey").alias("gt"), F.col("c_name").alias("prediction"))
    return A.match_baseline(preds, baseline)


@query("d8_pending_work", BOTH + """
SELECT m.model, i.item_id FROM (SELECT DISTINCT model FROM ev_predictions) m, ev_items i
WHERE NOT EXISTS (SELECT 1 FROM ev_predictions p WHERE p.model = m.model AND p.item_id = i.item_id)""")
def _(t):
    models = sorted(r["model"] for r in t.ev_predictions.select("model").distinct().limit(MAX_MODELS + 1).collect())
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    tasks = t.ev_items.select("item_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return A.pending_work(tasks, t.ev_predictions, ["model", "item_id"])


@query("d9_bad_cases", with_tables("ev_scored", "ev_label_scores") + """
SELECT s.model, s.item_id, s.pos, s.answer, s.gold, round(a.nll, 6) AS pred_nll, round(g.nll, 6) AS gold_nll FROM ev_scored s
LEFT JOIN ev_label_scores a ON a.item_id = s.item_id AND a.label = s.answer LEFT JOIN ev_label_scores g ON g.item_id = s.item_id AND g.label = s.gold
WHERE s.answer <> s.gold""")
def _(t):
    rows = A.bad_cases(t.ev_scored, t.ev_label_scores)
    return round6(rows.select("model", "item_id", "pos", "answer", "gold", "pred_nll", "gold_nll"))


@query("d12_union_runs", BOTH + """
SELECT model, item_id, answer, NULL AS gold FROM ev_predictions UNION ALL SELECT NULL, item_id, NULL, gold FROM ev_items""")
def _(t):
    return A.union_runs(t.ev_predictions.select("model", "item_id", "answer"), t.ev_items.select("item_id", "gold"))


@query("d13_fan_out_judges", with_tables("ev_battles") + """
SELECT item_id, pos, model_a, model_b, judge FROM ev_battles, (VALUES ('j0'), ('j1'), ('j2')) j(judge)""")
def _(t):
    return A.fan_out_judges(t.ev_battles.select("item_id", "pos", "model_a", "model_b"), ["j0", "j1", "j2"])


@query("d13_meta_input", with_tables("ev_judgements") + r"""
, v AS (SELECT DISTINCT item_id, model_a, model_b, judge || ':' || regexp_extract(verdict_text, '\[\[([AB<>=]+)\]\]', 1) AS x FROM ev_judgements)
SELECT item_id, model_a, model_b, string_agg(x, ',' ORDER BY x) AS verdicts FROM v GROUP BY item_id, model_a, model_b""")
def _(t):
    verdict = F.coalesce(E.verdict("arena")(F.col("verdict_text")), F.lit(""))
    rows = A.meta_input(t.ev_judgements, ["item_id", "model_a", "model_b"], verdict)
    flat = F.array_join(F.array_sort(F.transform("verdicts", lambda v: F.concat_ws(":", v["judge"], v["verdict"]))), ",")
    return rows.select("item_id", "model_a", "model_b", flat.alias("verdicts"))
