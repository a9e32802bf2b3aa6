"""Queries over text overlap and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import classify as C
from evalmill.operators import overlap as O
from evalmill.operators.ordering import dealt
from evalmill.plans.catalog import query
from evalmill.plans.extract_plans import entities
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import LCS, round6

PAIRS = with_tables("ev_text_pairs")


def grams_sql(tokens_p: str, tokens_r: str) -> str:
    """CTEs: per pair and n, matched, n_pred and n_ref."""
    def side(tokens: str, name: str) -> str:
        return f"""{name}t AS (SELECT model, pair_id, {tokens} AS k FROM ev_text_pairs),
{name}g AS (SELECT model, pair_id, n, array_to_string(k[i:i + n - 1], ' ') AS t, count(*) AS c FROM {name}t, (VALUES (1), (2), (3), (4)) o(n),
 LATERAL (SELECT unnest(range(1, len(k) - n + 2)) AS i) z GROUP BY ALL)"""
    return f""", {side(tokens_p, 'p')}, {side(tokens_r, 'r')},
j AS (SELECT coalesce(pg.model, rg.model) AS model, coalesce(pg.pair_id, rg.pair_id) AS pair_id, coalesce(pg.n, rg.n) AS n,
 sum(CASE WHEN pg.c IS NULL OR rg.c IS NULL THEN 0 ELSE least(pg.c, rg.c) END) AS matched, sum(coalesce(pg.c, 0)) AS n_pred, sum(coalesce(rg.c, 0)) AS n_ref
 FROM pg FULL JOIN rg ON pg.pair_id = rg.pair_id AND pg.n = rg.n AND pg.t = rg.t GROUP BY 1, 2, 3)
"""


WORDS_P = r"regexp_extract_all(lower(prediction), '[\p{L}\p{N}]+')"
WORDS_R = r"regexp_extract_all(lower(reference), '[\p{L}\p{N}]+')"
BLEU_P = r"regexp_extract_all(prediction, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')"
BLEU_R = r"regexp_extract_all(reference, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')"


@query("f22_rouge_n", PAIRS + grams_sql(WORDS_P, WORDS_R) + """
, n AS (SELECT model, count(*) AS n FROM ev_text_pairs GROUP BY model),
s AS (SELECT model, sum(2e0 * matched / (n_pred + n_ref)) FILTER (n = 1) AS a, sum(2e0 * matched / (n_pred + n_ref)) FILTER (n = 2) AS b FROM j GROUP BY model)
SELECT model, round(a / n * 100, 6) AS rouge1, round(b / n * 100, 6) AS rouge2 FROM s JOIN n USING (model)""")
def _(t):
    return round6(O.rouge_n(t.ev_text_pairs, ["model"]))


def cjk_words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


@query("f23_rouge_l", PAIRS + f"""
, w AS (SELECT model, {cjk_words('prediction')} AS p, {cjk_words("coalesce(reference, '')")} AS r FROM ev_text_pairs),
f AS (SELECT model, CASE WHEN len(p) + len(r) = 0 THEN 0e0 ELSE 2e0 * {LCS('p', 'r')} / (len(p) + len(r)) END AS f FROM w)
SELECT model, round(avg(f) * 100, 6) AS "rougeL" FROM f GROUP BY model""")
def _(t):
    return round6(O.rouge_l(t.ev_text_pairs.withColumn("refs", F.array("reference")), ["model"]))


@query("f24_corpus_bleu", PAIRS + grams_sql(BLEU_P, BLEU_R) + """
, s AS (SELECT model, """ + ", ".join(f"CAST(sum(matched) FILTER (n = {n}) AS DOUBLE) AS m{n}, CAST(sum(n_pred) FILTER (n = {n}) AS DOUBLE) AS t{n}" for n in (1, 2, 3, 4)) + """ FROM j GROUP BY model),
l AS (SELECT pt.model, CAST(sum(len(pt.k)) AS BIGINT) AS sys_len, CAST(sum(len(rt.k)) AS BIGINT) AS ref_len FROM pt JOIN rt USING (pair_id) GROUP BY pt.model),
z AS (SELECT *, CASE WHEN m1 = 0 THEN 1 ELSE 0 END AS z1, CASE WHEN m2 = 0 THEN 1 ELSE 0 END AS z2, CASE WHEN m3 = 0 THEN 1 ELSE 0 END AS z3, CASE WHEN m4 = 0 THEN 1 ELSE 0 END AS z4 FROM s)
SELECT model, round(CASE WHEN sys_len < ref_len THEN exp(1 - ref_len * 1e0 / sys_len) ELSE 1e0 END * exp((
 ln(CASE WHEN m1 = 0 THEN 100 / (pow(2, z1) * t1) ELSE 100 * m1 / t1 END) + ln(CASE WHEN m2 = 0 THEN 100 / (pow(2, z1 + z2) * t2) ELSE 100 * m2 / t2 END)
 + ln(CASE WHEN m3 = 0 THEN 100 / (pow(2, z1 + z2 + z3) * t3) ELSE 100 * m3 / t3 END) + ln(CASE WHEN m4 = 0 THEN 100 / (pow(2, z1 + z2 + z3 + z4) * t4) ELSE 100 * m4 / t4 END)) / 4), 6) AS bleu, sys_len, ref_len
FROM z JOIN l USING (model)""")
def _(t):
    return round6(O.corpus_bleu(t.ev_text_pairs.withColumn("refs", F.array("reference")), ["model"]))


@query("f25_corpus_gleu", PAIRS + grams_sql(WORDS_P, WORDS_R) + """
, g AS (SELECT model, pair_id, sum(matched) AS m, greatest(sum(n_pred), sum(n_ref)) AS t FROM j GROUP BY 1, 2)
SELECT model, round(sum(m) * 1e0 / sum(t) * 100, 6) AS gleu FROM g GROUP BY model""")
def _(t):
    return round6(O.corpus_gleu(t.ev_text_pairs, ["model"]))


@query("f26_probe_scores", with_tables("ev_url_pairs") + """
SELECT model, round(avg(CASE WHEN prediction = reference THEN 100e0 ELSE 0e0 END), 6) AS exact_match,
 round(avg(CASE WHEN 1 - levenshtein(prediction, reference) * 1e0 / greatest(length(prediction), length(reference), 1) > 0.75 THEN 100e0 ELSE 0e0 END), 6) AS edit_similarity
FROM ev_url_pairs GROUP BY model""")
def _(t):
    return round6(O.probe_scores(t.ev_url_pairs, ["model"]))


@query("f26_lcs_share", with_tables("ev_url_pairs") + f"""
, w AS (SELECT model, {WORDS_P} AS p, {WORDS_R} AS r FROM ev_url_pairs),
f AS (SELECT model, CASE WHEN len(p) + len(r) = 0 THEN 0e0 ELSE 2e0 * {LCS('p', 'r')} / (len(p) + len(r)) END AS f FROM w)
SELECT model, round(avg(CASE WHEN f > 0.75 THEN 100e0 ELSE 0e0 END), 6) AS "rougeL" FROM f GROUP BY model""")
def _(t):
    return round6(O.lcs_share(t.ev_url_pairs, ["model"]))


@query("f27_code_similarity", PAIRS + rf"""
, c AS (SELECT model, reference, list_filter(string_split(regexp_replace(prediction, '^\n+', ''), chr(10)), lambda l: NOT regexp_matches(l, '`|#|//')) AS ls FROM ev_text_pairs),
w AS (SELECT model, CASE WHEN len(ls) = 0 OR ls[1] = '' THEN []::VARCHAR[] ELSE string_split(ls[1], '') END AS p, CASE WHEN reference = '' THEN []::VARCHAR[] ELSE string_split(reference, '') END AS r FROM c),
f AS (SELECT model, CASE WHEN len(p) + len(r) = 0 THEN 1e0 ELSE 2e0 * {LCS('r', 'p')} / (len(p) + len(r)) END AS f FROM w)
SELECT model, round(avg(f) * 100, 6) AS score FROM f GROUP BY model""")
def _(t):
    return round6(O.code_similarity(t.ev_text_pairs.withColumn("refs", F.array("reference")), ["model"]))


@query("f28_truthfulness", """
WITH u AS (SELECT p_partkey AS item_id, p_brand AS model, p_name AS p, unnest([{'r': p_type, 't': true}, {'r': 'red bolt', 't': true}, {'r': p_brand, 't': false}, {'r': 'green nut', 't': false}]) AS x FROM part),
s AS (SELECT model, item_id, x.t AS is_true, 1 - levenshtein(p, x.r) * 1e0 / greatest(length(p), length(x.r), 1) AS sim FROM u),
i AS (SELECT model, item_id, max(sim) FILTER (is_true) AS t, max(sim) FILTER (NOT is_true) AS f FROM s GROUP BY 1, 2)
SELECT model, round(avg(t), 6) AS max, round(avg(t - f), 6) AS diff, round(avg(CASE WHEN t > f THEN 1e0 ELSE 0e0 END), 6) AS acc FROM i GROUP BY model""")
def _(t):
    ref = lambda c, flag: F.struct(c.alias("r"), F.lit(flag).alias("is_true"))
    refs = F.explode(F.array(ref(F.col("p_type"), True), ref(F.lit("red bolt"), True), ref(F.col("p_brand"), False), ref(F.lit("green nut"), False)))
    rows = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("model"), F.col("p_name").alias("p"), refs.alias("x"))
    sims = rows.select("model", "item_id", "x.is_true", O.edit_similarity(F.col("p"), F.col("x.r")).alias("sim"))
    return round6(O.truthfulness(sims, ["model"]))


SCORES = "WITH s AS (SELECT l_linestatus AS model, (l_partkey % 997) / 997e0 AS p1, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"


def class_scores(t):
    return t.lineitem.select(
        F.col("l_linestatus").alias("model"), ((F.col("l_partkey") % 997) / F.lit(997.0)).alias("p1"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


@query("f29_auc", SCORES + """
, c AS (SELECT model, p1, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, count(*) FILTER ((p1 > 0.5) = (label = 1)) AS ok FROM s GROUP BY model, p1),
r AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p1) AS below FROM c)
SELECT model, round(sum(pos * (below - neg / 2e0)) / (sum(pos) * sum(neg)) * 100, 6) AS auc_score, round(sum(ok) * 100e0 / sum(pos + neg), 6) AS accuracy FROM r GROUP BY model""")
def _(t):
    return round6(C.auc(class_scores(t), ["model"]))


SCORED = with_tables("ev_scored")


@query("f30_matthews", SCORED + """
, c AS (SELECT model, answer AS p, gold AS r, count(*) AS n FROM ev_scored GROUP BY ALL),
k AS (SELECT model, x AS c, sum(n) FILTER (p = x) AS np, sum(n) FILTER (r = x) AS nr, sum(n) FILTER (p = x AND r = x) AS tp FROM c, (VALUES ('A'), ('B'), ('C'), ('D')) v(x) GROUP BY 1, 2),
q AS (SELECT model, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(nr) AS DOUBLE) AS s, CAST(sum(np * nr) AS DOUBLE) AS pt, CAST(sum(np * np) AS DOUBLE) AS pp, CAST(sum(nr * nr) AS DOUBLE) AS tt FROM k GROUP BY model)
SELECT model, round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) * 100, 6) AS matthews_correlation FROM q""")
def _(t):
    return round6(C.matthews(t.ev_scored, ["model"]))


@query("f31_binary_report", SCORES + """
, c AS (SELECT model, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS pred, label FROM s),
q AS (SELECT model, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = label) AS ok, count(*) AS n FROM c GROUP BY model)
SELECT model, round(ok * 1e0 / n, 6) AS accuracy, round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score FROM q""")
def _(t):
    return round6(C.binary_report(class_scores(t).withColumn("pred", (F.col("p1") > 0.5).cast("int")), ["model"]))


@query("f32_class_report", SCORED + """
, k AS (SELECT model, x AS c, count(*) FILTER (answer = x) AS np, count(*) FILTER (gold = x) AS nr, count(*) FILTER (answer = x AND gold = x) AS tp FROM ev_scored, (VALUES ('A'), ('B'), ('C'), ('D')) v(x) GROUP BY 1, 2),
f AS (SELECT *, tp * 1e0 / np AS precision, tp * 1e0 / nr AS recall, 2e0 * tp / (np + nr) AS f1 FROM k)
SELECT model, """ + ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * nr) / sum(nr), 6) AS weighted_{m}" for m in ["precision", "recall", "f1"]) + " FROM f GROUP BY model")
def _(t):
    return round6(C.class_report(t.ev_scored, ["model"]))


@query("f33_entity_micro_f1", """
WITH g AS (SELECT DISTINCT l_returnflag AS model, l_orderkey AS item_id, 'p' || CAST(l_partkey % 20 AS VARCHAR) AS e FROM lineitem),
p AS (SELECT DISTINCT l_returnflag AS model, l_orderkey AS item_id, 'p' || CAST(l_suppkey % 20 AS VARCHAR) AS e FROM lineitem),
j AS (SELECT coalesce(p.model, g.model) AS model, p.e IS NOT NULL AS p, g.e IS NOT NULL AS g FROM p FULL JOIN g ON p.model = g.model AND p.item_id = g.item_id AND p.e = g.e),
q AS (SELECT model, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p) AS np, count(*) FILTER (g) AS ng FROM j GROUP BY model)
SELECT model, round(tp * 1e0 / np, 6) AS precision, round(tp * 1e0 / ng, 6) AS recall, round(2e0 * tp / (np + ng), 6) AS f1 FROM q""")
def _(t):
    rows = dealt(t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey"), ["l_returnflag", "l_orderkey"]).groupBy(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("item_id")).agg(
        F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 20)).alias("gold_entities"),
        F.collect_set(F.concat(F.lit("p"), F.col("l_suppkey") % 20)).alias("pred_entities"),
    )
    return round6(C.entity_micro_f1(rows, ["model"]))


@query("f34_typed_entity_f1", with_tables("ev_items") + """
, b AS (SELECT item_id, 'gold' AS s, x.k AS k, x.v AS v FROM ev_items, LATERAL (SELECT unnest([{'k': 'priority', 'v': category}, {'k': 'status', 'v': difficulty}]) AS x) z
 UNION ALL SELECT item_id, 'said', 'priority', split_part(category, ' ', 1) FROM ev_items WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, 'said', 'status', 'F' FROM ev_items WHERE item_id % 4 <> 0),
c AS (SELECT item_id, s, k, ch, count(*) AS n FROM (SELECT item_id, s, k, unnest(string_split(v, '')) AS ch FROM b) WHERE ch <> ' ' GROUP BY ALL),
z AS (SELECT item_id, s, k, sum(n) AS n FROM c GROUP BY ALL),
o AS (SELECT g.item_id, g.k, sum(least(g.n, p.n)) AS both_ FROM c g JOIN c p ON g.s = 'gold' AND p.s = 'said' AND g.item_id = p.item_id AND g.k = p.k AND g.ch = p.ch GROUP BY 1, 2),
f AS (SELECT o.item_id, sum(2e0 * both_ / (g.n + p.n)) AS hit FROM o JOIN z g ON g.s = 'gold' AND g.item_id = o.item_id AND g.k = o.k JOIN z p ON p.s = 'said' AND p.item_id = o.item_id AND p.k = o.k GROUP BY 1),
r AS (SELECT i.item_id, coalesce(hit, 0e0) AS hit, CASE WHEN i.item_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN i.item_id % 4 <> 0 THEN 1 ELSE 0 END AS np FROM ev_items i LEFT JOIN f USING (item_id)),
m AS (SELECT np, CASE WHEN np > 0 THEN hit / np ELSE 0e0 END AS pr, hit / 2e0 AS rc FROM r)
SELECT 'all' AS model, round(avg(2 * pr * rc / (pr + rc + 1e-10)), 6) AS score, round(avg(CASE WHEN np = 0 THEN 1e0 ELSE 0e0 END), 6) AS abstention_rate FROM m""")
def _(t):
    return round6(C.typed_entity_f1(entities(t).withColumn("model", F.lit("all")), ["model"]))


def number_pairs(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.when(F.col("l_partkey") % 10 == 0, "none").otherwise(F.concat(F.lit("about "), F.col("l_quantity"))).alias("prediction"),
        F.concat(F.lit("exactly "), F.col("l_linenumber") * 7).alias("reference"),
    )


@query("f35_mean_absolute_error", """
SELECT l_returnflag AS model, round(avg(CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE abs(l_quantity - l_linenumber * 7) END), 6) AS mae FROM lineitem GROUP BY l_returnflag""")
def _(t):
    strip = lambda c: F.regexp_replace(c, "^(about|exactly) ", "")
    rows = number_pairs(t).withColumns({"prediction": strip("prediction"), "reference": strip("reference")})
    return round6(C.mean_absolute_error(rows, ["model"]))


@query("f36_row_rmse", """
WITH s AS (SELECT l_returnflag AS model, CASE WHEN l_partkey % 10 = 0 THEN 0e0 ELSE l_quantity END - l_linenumber * 7 AS g FROM lineitem)
SELECT model, round(avg(abs(g)), 6) AS score, round(sqrt(avg(g * g)), 6) AS rmse FROM s GROUP BY model""")
def _(t):
    return round6(C.row_rmse(number_pairs(t), ["model"]))


def ranked(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 4 == F.col("l_orderkey") % 4).alias("right"),
    )


@query("f37_top_k_hit", """
WITH i AS (SELECT l_returnflag AS model, l_orderkey, max(CASE WHEN l_partkey % 4 = l_orderkey % 4 THEN 1 ELSE 0 END) AS hit FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)
SELECT model, round(avg(hit) * 100, 6) AS top3 FROM i GROUP BY model""")
def _(t):
    return round6(C.top_k_hit(ranked(t), ["model"], 3))


@query("f37_rank_scores", """
SELECT l_returnflag AS model, l_linenumber AS rank, round(avg(CASE WHEN l_partkey % 4 = l_orderkey % 4 THEN 100e0 ELSE 0e0 END), 6) AS score FROM lineitem GROUP BY 1, 2""")
def _(t):
    return round6(C.rank_scores(ranked(t), ["model"]))


@query("f37a_table_f1", with_tables("ev_scored") + f"""
, s AS (SELECT model, CASE CAST(item_id % 4 AS INT)
 WHEN 0 THEN CASE WHEN answer = gold THEN 2e0 * 3 / 6 ELSE 2e0 * 2 / 6 END
 WHEN 1 THEN CASE WHEN answer = gold THEN 2e0 * 2 / 4 ELSE 2e0 * 1 / 4 END
 WHEN 2 THEN CASE WHEN pos % 5 = item_id % 5 THEN 1e0 ELSE 0e0 END
 ELSE CASE WHEN answer = gold THEN 1e0 WHEN gold = 'A' OR answer = 'A' THEN 2e0 * 2 / 5 ELSE 2e0 * 2 / 6 END END AS f FROM ev_scored)
SELECT model, round(avg(f) * 100, 6) AS score FROM s GROUP BY model""")
def _(t):
    kind = (F.col("item_id") % 4).cast("int")
    table = lambda letter: F.concat(F.lit("| name | letter |\n|---|---|\n| x | 1 |\n| Y | "), F.col(letter), F.lit(" |"))
    keyed = t.wide("ev_scored").withColumn("key", F.monotonically_increasing_id())
    rows = keyed.select(
        "model", F.col("key").alias("item_id"),
        F.when(kind == 0, table("answer"))
        .when(kind == 1, F.concat(F.lit("b , "), "answer"))
        .when(kind == 2, (F.col("pos") % 5).cast("string"))
        .otherwise(F.concat(F.lit("The city is "), "answer")).alias("prediction"),
        F.when(kind == 0, table("gold"))
        .when(kind == 1, F.concat("gold", F.lit(",b")) )
        .when(kind == 2, F.concat((F.col("item_id") % 5).cast("string"), F.lit(".0")))
        .otherwise(F.when(F.col("gold") == "A", "city is a").otherwise(F.concat_ws(" ", F.lit("is city"), "gold"))).alias("reference"),
    )
    return round6(C.table_f1(rows, ["model"]))


@query("f37b_regression_report", """
WITH s AS (SELECT l_returnflag AS model, l_extendedprice AS y, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * 1500 END AS f FROM lineitem),
q AS (SELECT model, avg((y - f) * (y - f)) AS mse, var_pop(y) FILTER (f IS NOT NULL) AS v, avg(CASE WHEN f IS NOT NULL THEN 1e0 ELSE 0e0 END) AS valid FROM s GROUP BY model)
SELECT model, round(sqrt(mse), 4) AS rmse, round(mse / v, 6) AS nmse, round(1 - mse / v, 6) AS r2, round(valid, 6) AS valid FROM q""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity") * 1500).alias("y_hat"),
    )
    return round6(C.regression_report(rows, ["model"]).withColumn("rmse", F.round("rmse", 4)))
