"""Queries over exactness metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import exact as X
from evalmill.plans.catalog import Tables, query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import GENERAL, QA_NORM, SHORT, round6

SCORED = with_tables("ev_scored")
PAIRS = with_tables("ev_text_pairs")
SLICE = ["model", "category"]


@query("f1_accuracy", SCORED + """
SELECT model, category, round(avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM ev_scored GROUP BY model, category""")
def _(t: Tables):
    return round6(X.accuracy(t.ev_scored, SLICE))


@query("f2_exact_match", SCORED + f"""
SELECT model, category, round(avg(CASE WHEN {GENERAL('prediction')} IN ({GENERAL('gold')}, {GENERAL("'Choice ' || gold")}, gold, 'Choice ' || gold)
  THEN 100e0 ELSE 0e0 END), 6) AS exact_match FROM ev_scored GROUP BY model, category""")
def _(t):
    rows = t.wide("ev_scored").withColumn("refs", F.array("gold", F.concat(F.lit("Choice "), "gold")))
    return round6(X.exact_match(rows, SLICE))


@query("f3_contained_answer", SCORED + f"""
SELECT model, category, round(avg(CASE WHEN contains({SHORT('prediction')}, lower({GENERAL('gold')}))
  OR contains({SHORT('prediction')}, lower({GENERAL("'Choice ' || gold")})) THEN 100e0 ELSE 0e0 END), 6) AS score
FROM ev_scored GROUP BY model, category""")
def _(t):
    rows = t.wide("ev_scored").withColumn("refs", F.array("gold", F.concat(F.lit("Choice "), "gold")))
    return round6(X.contained_answer(rows, SLICE))


@query("f4_equal_answer", SCORED + f"""
SELECT model, category, round(avg(CASE WHEN {SHORT('prediction')} = lower({GENERAL('gold')}) THEN 100e0 ELSE 0e0 END), 6) AS score
FROM ev_scored GROUP BY model, category""")
def _(t):
    return round6(X.equal_answer(t.wide("ev_scored").withColumn("refs", F.array("gold")), SLICE))


@query("f4_fuzzy_match", SCORED + f"""
, s AS (SELECT *, {QA_NORM("CASE WHEN regexp_matches(prediction, '(?i)Answer\\s*:\\s*([^\\n]+)') THEN regexp_extract(prediction, '(?i)Answer\\s*:\\s*([^\\n]+)', 1) ELSE prediction END")} AS p,
  {QA_NORM('gold')} AS r FROM ev_scored)
SELECT model, category, round(avg(CASE WHEN CASE WHEN p = '' OR r = '' THEN p = r ELSE contains(p, r) OR contains(r, p) END THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM s GROUP BY model, category""")
def _(t):
    return round6(X.fuzzy_match(t.wide("ev_scored"), SLICE, ref="gold"))


@query("f5_either_form_contained", SCORED + f"""
SELECT model, category, round(avg(CASE WHEN contains({GENERAL('prediction')}, {GENERAL('gold')}) OR contains({GENERAL('prediction')}, gold)
  THEN 100e0 ELSE 0e0 END), 6) AS score FROM ev_scored GROUP BY model, category""")
def _(t):
    return round6(X.either_form_contained(t.wide("ev_scored"), SLICE, ref="gold"))


@query("f6_first_word_accuracy", PAIRS + f"""
, s AS (SELECT model, regexp_extract(split_part(trim(prediction, ' ' || chr(9) || chr(10) || chr(13)), ' ', 1), '^[^!-/:-@\\[-`{{-~]*') AS w, reference FROM ev_text_pairs)
SELECT model, round(avg(CASE WHEN {GENERAL('w')} = {GENERAL("reference")} THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM s GROUP BY model""")
def _(t):
    return round6(X.first_word_accuracy(t.ev_text_pairs, ["model"]))


TOKEN_F1 = f"""
, s AS (SELECT model, pair_id, {QA_NORM('prediction')} AS p, {QA_NORM('reference')} AS r FROM ev_text_pairs),
pt AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(string_split(p, ' ')) AS t FROM s) WHERE t <> '' GROUP BY ALL),
rt AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(string_split(r, ' ')) AS t FROM s) WHERE t <> '' GROUP BY ALL),
pn AS (SELECT pair_id, sum(n) AS n FROM pt GROUP BY 1), rn AS (SELECT pair_id, sum(n) AS n FROM rt GROUP BY 1),
both_ AS (SELECT pt.pair_id, sum(least(pt.n, rt.n)) AS n FROM pt JOIN rt ON pt.pair_id = rt.pair_id AND pt.t = rt.t GROUP BY 1),
f AS (SELECT s.model, s.pair_id, p, r, coalesce(2e0 * both_.n / (pn.n + rn.n), 0e0) AS f1
  FROM s LEFT JOIN both_ USING (pair_id) LEFT JOIN pn USING (pair_id) LEFT JOIN rn USING (pair_id))
"""


@query("f7_token_f1", PAIRS + TOKEN_F1 + """
SELECT model, round(avg(f1) * 100, 6) AS f1, round(avg(CASE WHEN p = r THEN 1e0 ELSE 0e0 END) * 100, 6) AS em FROM f GROUP BY model""")
def _(t):
    return round6(X.token_f1(t.ev_text_pairs.withColumn("refs", F.array("reference")), ["model"]))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS_EN) + ")"


@query("f8_gated_f1", PAIRS + TOKEN_F1 + f"""
, k AS (SELECT s.pair_id, coalesce(sum(CASE WHEN pt.n IS NOT NULL AND rt.t NOT IN {STOP_SQL} THEN least(pt.n, rt.n) END), 0) * 1e0 / nullif(any_value(rn.n), 0) AS recall
  FROM s LEFT JOIN rt USING (pair_id) LEFT JOIN pt ON pt.pair_id = rt.pair_id AND pt.t = rt.t LEFT JOIN rn ON rn.pair_id = s.pair_id GROUP BY s.pair_id)
SELECT model, round(avg(CASE WHEN recall IS NULL OR recall >= 0.2 THEN f1 ELSE 0e0 END) * 100, 6) AS f1
FROM f JOIN k USING (pair_id) GROUP BY model""")
def _(t):
    return round6(X.gated_f1(t.ev_text_pairs.withColumn("keyword", F.col("reference")), ["model"]))


@query("f9_numeric_accuracy", SCORED + """
, s AS (SELECT model, category, CASE WHEN item_id % 3 = 0 THEN prediction ELSE CAST(item_id % 50 AS VARCHAR) END AS p, CAST(pos % 50 AS VARCHAR) || '.0' AS r FROM ev_scored)
SELECT model, category, round(avg(CASE WHEN p = r OR abs(TRY_CAST(p AS DOUBLE) - TRY_CAST(r AS DOUBLE)) < 1e-3 THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM s GROUP BY model, category""")
def _(t):
    rows = t.ev_scored.withColumn(
        "prediction",
        F.when(F.col("item_id") % 3 == 0, F.col("prediction")).otherwise((F.col("item_id") % 50).cast("string")),
    ).withColumn("reference", F.concat((F.col("pos") % 50).cast("string"), F.lit(".0")))
    return round6(X.numeric_accuracy(rows, SLICE))


@query("f9_within_limits", """
SELECT l_returnflag AS model, round(avg(CASE WHEN l_quantity BETWEEN l_linenumber * 2 AND l_linenumber * 5 THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_quantity").cast("string").alias("prediction"),
        (F.col("l_linenumber") * 2).alias("lower"),
        (F.col("l_linenumber") * 5).alias("upper"),
    )
    return round6(X.within_limits(rows, ["model"]))


@query("f10_math_string_accuracy", with_tables("ev_predictions") + """
SELECT model, round(avg(CASE WHEN item_id % 10 = pos % 10 THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM ev_predictions GROUP BY model""")
def _(t):
    digit = lambda c: (F.col(c) % 10).cast("string")
    rows = t.wide("ev_predictions").withColumn(
        "prediction", F.concat(F.lit(r"x=\left\dfrac{1}{"), digit("item_id"), F.lit("}^\\circ"))
    ).withColumn("reference", F.concat(F.lit(r"\tfrac{1} {"), digit("pos"), F.lit("}")))
    return round6(X.math_accuracy(rows, ["model"]))


# pairs of forms that are alike after the second clean-up, {} being a digit
MATH_FORMS = [
    ("  $\\dfrac{1}{{}}$.\n", "\\frac1{}"), ("x = \\sqrt{}", "\\sqrt{{}}"), ("{}.00", "{}"), ("{}\\text{ miles}", "{}\\%"), ("3/{}", "\\tfrac{3}{{}}"),
    ("{} + inf", "{}+infinity"), ("x\\in [{}, \\infty)", "\\left[{},\\infty\\right)"), ("{}j", "{} i"),
]


@query("f10_math_string_v2", with_tables("ev_predictions") + """
SELECT model, round(avg(CASE WHEN item_id % 10 = pos % 10 THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM ev_predictions GROUP BY model""")
def _(t):
    """Every form stands in many rows; a row is right if both digits are the same."""
    form = lambda side, digit: F.replace(F.get(F.array(*[F.lit(f[side]) for f in MATH_FORMS]), ((F.col("item_id") + F.col("pos")) % 8).cast("int")), F.lit("{}"), (F.col(digit) % 10).cast("string"))
    rows = t.wide("ev_predictions").withColumn("prediction", form(0, "item_id")).withColumn("reference", form(1, "pos"))
    return round6(X.math_accuracy(rows, ["model"], version="v2"))


@query("f11_nearest_candidate", """
WITH s AS (SELECT p_brand AS model, CAST(p_partkey % 3 AS INT) AS label, p_name,
  least(levenshtein(p_name, 'red bolt'), levenshtein(p_name, 'green nut')) AS a, levenshtein(p_name, 'blue widget') AS b, levenshtein(p_name, p_type) AS c FROM part)
SELECT model, round(avg(CASE WHEN CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END = label THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM s GROUP BY model""")
def _(t):
    rows = t.part.select(
        F.col("p_brand").alias("model"),
        F.col("p_name").alias("prediction"),
        F.array(
            F.array(F.lit("red bolt"), F.lit("green nut")), F.array(F.lit("blue widget")), F.array("p_type")
        ).alias("candidates"),
        (F.col("p_partkey") % 3).cast("int").alias("label"),
    )
    return round6(X.nearest_candidate(rows, ["model"]))


@query("f12_option_similarity", """
WITH s AS (SELECT p_brand, substr('ABC', CAST(p_partkey % 3 AS INT) + 1, 1) AS gold, trim(p_name, ' ' || chr(9) || chr(10) || chr(13)) AS p, p_type AS a, 'red widget' AS b, 'blue' AS c FROM part),
h AS (SELECT *, list_filter(['A', 'B', 'C'], lambda x: contains(lower(p), lower(CASE x WHEN 'A' THEN a WHEN 'B' THEN b ELSE c END))) AS held,
 least(levenshtein(p, 'A'), levenshtein(p, a), levenshtein(p, 'A. ' || a)) AS da,
 least(levenshtein(p, 'B'), levenshtein(p, b), levenshtein(p, 'B. ' || b)) AS db,
 least(levenshtein(p, 'C'), levenshtein(p, c), levenshtein(p, 'C. ' || c)) AS dc FROM s)
SELECT p_brand AS model, round(avg(CASE WHEN CASE WHEN len(held) = 1 THEN held[1] WHEN da <= db AND da <= dc THEN 'A' WHEN db <= dc THEN 'B' ELSE 'C' END = gold
 THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM h GROUP BY p_brand""")
def _(t):
    rows = t.part.select(
        F.col("p_brand").alias("model"),
        F.col("p_name").alias("prediction"),
        F.substr(F.lit("ABC"), (F.col("p_partkey") % 3).cast("int") + 1, F.lit(1)).alias("gold"),
        F.col("p_type").alias("a"),
        F.lit("red widget").alias("b"),
        F.lit("blue").alias("c"),
    )
    return round6(X.option_similarity(rows, ["model"], {"A": "a", "B": "b", "C": "c"}))


@query("f13_option_abstention", SCORED + """
, s AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda x: contains(prediction, x)) AS held FROM ev_scored)
SELECT model, category, round(avg(CASE WHEN len(held) = 1 AND held[1] = gold THEN 100e0 ELSE 0e0 END), 6) AS score,
 round(avg(CASE WHEN len(held) = 0 THEN 100e0 ELSE 0e0 END), 6) AS abstention FROM s GROUP BY model, category""")
def _(t):
    return round6(X.option_abstention(t.ev_scored, SLICE))


@query("f14_valid_accuracy", SCORED + """
, s AS (SELECT model, category, gold, CASE WHEN answer = 'D' THEN 'invalid' ELSE answer END AS a FROM ev_scored)
SELECT model, category, round(round(count(*) FILTER (a = gold) * 1e0 / count(*), 4) * 100, 6) AS accuracy,
 round(round(count(*) FILTER (a = gold AND a <> 'invalid') * 1e0 / count(*) FILTER (a <> 'invalid'), 4) * 100, 6) AS valid_accuracy,
 round(round(count(*) FILTER (a <> 'invalid') * 1e0 / count(*), 4) * 100, 6) AS valid_frac FROM s GROUP BY model, category""")
def _(t):
    rows = t.ev_scored.withColumn("answer", F.when(F.col("answer") == "D", "invalid").otherwise(F.col("answer")))
    return round6(X.valid_accuracy(rows, SLICE))


@query("f15_pass_rate", SCORED + """
SELECT model, category, round(avg(CASE WHEN length(prediction) > 0 AND NOT regexp_matches(lower(prediction), 'sorry|apologize|apology|unfortunately|couldn''t')
 THEN 100e0 ELSE 0e0 END), 6) AS pass_rate FROM ev_scored GROUP BY model, category""")
def _(t):
    return round6(X.pass_rate(t.ev_scored, SLICE))


@query("f16_extraction_rate", SCORED + """
SELECT model, category, round(avg(CASE WHEN length(regexp_extract(prediction, '[A-D]+')) > 0 THEN 100e0 ELSE 0e0 END), 6) AS extract_rate
FROM ev_scored GROUP BY model, category""")
def _(t):
    return round6(X.extraction_rate(E.extract(t.ev_scored, E.first_run), SLICE))


@query("f17_prefix_match", """
WITH s AS (SELECT l_returnflag AS model, l_quantity % 4 = l_linenumber % 4 AS a, l_suppkey % 4 = l_partkey % 4 AS b, l_orderkey % 3 = l_linenumber % 3 AS c FROM lineitem)
SELECT model, round(avg(CASE WHEN NOT a THEN 0e0 WHEN NOT b THEN 1e0 WHEN NOT c THEN 2e0 ELSE 3e0 END) * 100, 6) AS score FROM s GROUP BY model""")
def _(t):
    text = lambda q, s, o: F.concat_ws(
        ", ", (F.col(q) % 4).cast("int"), (F.col(s) % 4).cast("int"), (F.col(o) % 3).cast("int")
    )
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.concat(F.lit("got "), text("l_quantity", "l_suppkey", "l_orderkey")).alias("prediction"),
        text("l_linenumber", "l_partkey", "l_linenumber").alias("reference"),
    )
    return round6(X.prefix_match(rows, ["model"]))


@query("f18_number_ratio", with_tables("ev_predictions") + """
, s AS (SELECT model, regexp_extract_all(prediction || ' ' || CAST(item_id % 7 AS VARCHAR) || ' ' || CAST(pos % 5 AS VARCHAR), '[0-9]+') AS n, CAST(pos % 5 AS VARCHAR) AS t FROM ev_predictions)
SELECT model, round(avg(len(list_filter(n, lambda x: x = t)) * 1e0 / len(n)) * 100, 6) AS score FROM s GROUP BY model""")
def _(t):
    rows = t.ev_predictions.withColumn(
        "prediction", F.concat_ws(" ", "prediction", F.col("item_id") % 7, F.col("pos") % 5)
    ).withColumn("target", (F.col("pos") % 5).cast("string"))
    return round6(X.number_ratio(rows, ["model"]))


@query("f19_class_credit", """
WITH s AS (SELECT p_brand AS model, p_name, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'red bolt' WHEN 1 THEN 'blue' ELSE 'widget' END AS gold FROM part),
h AS (SELECT *, list_filter(['red', 'blue', 'green', 'bolt', 'widget', 'red bolt'], lambda c: contains(p_name, c) AND NOT (contains(gold, c) AND c <> gold)) AS f FROM s)
SELECT model, round(avg(CASE WHEN list_contains(f, gold) THEN 1e0 / len(f) ELSE 0e0 END) * 100, 6) AS score FROM h GROUP BY model""")
def _(t):
    k = F.col("p_partkey") % 3
    rows = t.part.select(
        F.col("p_brand").alias("model"),
        F.col("p_name").alias("prediction"),
        F.when(k == 0, "red bolt").when(k == 1, "blue").otherwise("widget").alias("gold"),
    )
    return round6(X.class_credit(rows, ["model"], ["red", "blue", "green", "bolt", "widget", "red bolt"]))


@query("f20_reversal_accuracy", """
WITH p AS (SELECT a.role, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
d AS (SELECT 'forward' AS direction, x || ' ' || CASE WHEN role = 'user' THEN y ELSE '' END AS prediction, y AS answer FROM p
 UNION ALL SELECT 'reverse', y, x FROM p)
SELECT direction, round(avg(CASE WHEN contains(prediction, answer) THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM d GROUP BY direction""")
def _(t):
    from evalmill.operators.prompts import line_pairs

    rows = line_pairs(t.conversations, ["conv_id"], "turn", "text", keep=["role"])
    rows = rows.withColumn(
        "prediction",
        F.when(
            F.col("direction") == "forward",
            F.concat_ws(" ", "question", F.when(F.col("role") == "user", F.col("answer")).otherwise("")),
        ).otherwise(F.col("question")),
    )
    return round6(X.reversal_accuracy(rows, ["direction"]))


@query("f21_reference_coverage", """
WITH s AS (SELECT lang, lower(text) AS p, ['the', 'und', 'que', 'de la'] AS refs FROM documents),
h AS (SELECT lang, len(list_filter(refs, lambda r: contains(p, r))) AS n FROM s)
SELECT lang, round(avg(n / 4e0) * 100, 6) AS part_match, round(avg(CASE WHEN n > 0 THEN 100e0 ELSE 0e0 END), 6) AS any_match,
 round(avg(CASE WHEN n = 4 THEN 100e0 ELSE 0e0 END), 6) AS all_match FROM h GROUP BY lang""")
def _(t):
    refs = F.array(*[F.lit(w) for w in ["the", "und", "que", "de la"]])
    return round6(X.coverage(t.documents.withColumn("refs", refs), ["lang"], pred="text"))


@query("f21a_point_weighted", with_tables("ev_scored") + """
, s AS (SELECT model, answer AS p1, gold AS r1, answer AS p2, CASE WHEN gold = 'D' THEN 'D' ELSE gold || 'D' END AS r2, difficulty FROM ev_scored),
q AS (SELECT model, CASE WHEN difficulty = 'P' THEN 0 ELSE CASE WHEN p1 = r1 THEN 2 ELSE 0 END + CASE WHEN p2 = r2 THEN 2 WHEN contains(r2, p2) THEN 1 ELSE 0 END END AS e FROM s)
SELECT model, round(sum(e) / (4e0 * count(*)) * 100, 6) AS score FROM q GROUP BY model""")
def _(t):
    rows = t.ev_scored.withColumn(
        "letters", F.when(F.col("difficulty") == "P", F.array("answer")).otherwise(F.array("answer", "answer"))
    ).withColumn(
        "ref_letters",
        F.array(
            F.col("gold"), F.when(F.col("gold") == "D", F.col("gold")).otherwise(F.concat("gold", F.lit("D")))
        ),
    )
    return round6(X.point_weighted(rows, ["model"]))
