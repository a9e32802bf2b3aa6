"""Queries over robustness metrics and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import instructions as I
from evalmill.operators import prompts as P
from evalmill.operators import slices as S
from evalmill.plans.align_plans import contamination_tags
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6

SCORED = with_tables("ev_scored")
ACC = "round(avg(CASE WHEN {c} THEN 100e0 ELSE 0e0 END), 6)"


def acc(c: str) -> str:
    return ACC.replace("{c}", c)


@query("f55_contamination_accuracy", """
WITH s AS (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'not labeled' WHEN toxic = 1 THEN 'both' WHEN quality = 0 THEN 'input' ELSE 'clean' END AS tag, n_chars % 2 = 0 AS ok FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, round(avg(CASE WHEN ok THEN 100e0 ELSE 0e0 END) FILTER (tag = 'clean'), 6) AS "accuracy - clean", round(avg(CASE WHEN ok THEN 100e0 ELSE 0e0 END) FILTER (tag = 'input'), 6) AS "accuracy - input contaminated",
 round(avg(CASE WHEN ok THEN 100e0 ELSE 0e0 END) FILTER (tag = 'both'), 6) AS "accuracy - input-and-label contaminated" FROM s GROUP BY lang""")
def _(t):
    from evalmill.operators.align import tag_contamination

    rows = tag_contamination(t.documents.select("doc_id", "lang", (F.col("n_chars") % 2 == 0).alias("right")), contamination_tags(t), "doc_id")
    return round6(S.contamination_accuracy(rows, ["lang"]))


@query("f56_accuracy_drop", SCORED + """
, a AS (SELECT model, avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) FILTER (difficulty = 'P') AS x, avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) FILTER (difficulty <> 'P') AS y FROM ev_scored GROUP BY model)
SELECT model, round(x, 6) AS acc_after, round(y, 6) AS acc_before, round(1 - x / y, 6) AS acc_drop FROM a""")
def _(t):
    rows = t.ev_scored.select(
        "model", F.when(F.col("difficulty") == "P", "perturbed").otherwise("original").alias("variant"),
        (F.col("answer") == F.col("gold")).alias("right"),
    )
    return round6(S.accuracy_drop(rows, ["model"]))


# letters A-D or the invalid X, from the item and the place of its rotation
CIRCULAR = """WITH c AS (SELECT CAST(p_size % 3 AS INT) AS model, p_partkey AS qid, k AS pos, ['ABCD', 'BCDA', 'CDAB', 'DABC'][k] AS p,
 substr('ABCDX', CAST((p_partkey * 7 + k * k * p_size) % 5 AS INT) + 1, 1) AS pred, substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS g FROM part, (VALUES (1), (2), (3), (4)) x(k)),
r AS (SELECT *, substr('ABCD', strpos(p, g), 1) AS gold FROM c),
s AS (SELECT *, CASE WHEN pred = gold THEN 1 ELSE 0 END AS ok, CASE WHEN pred = 'X' THEN '-' ELSE substr(p, strpos('ABCD', pred), 1) END AS vote FROM r),
q AS (SELECT model, qid, sum(ok) AS r4, sum(ok) FILTER (p = 'ABCD') AS r1, max(g) AS g, max(vote) FILTER (p = 'ABCD') AS v1 FROM s GROUP BY 1, 2),
v AS (SELECT model, qid, vote, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, min(pos)) AS k FROM s GROUP BY 1, 2, 3),
n AS (SELECT model, count(*) AS n FROM s GROUP BY model)
"""
CIRCULAR_METRICS = (
    [("acc_4", "sum(r4) * 1e0 / any_value(n) * 100"), ("acc_1", "sum(r1) * 4e0 / any_value(n) * 100")]
    + [(f"more_4_{j}", f"avg(CASE WHEN r4 >= {j} THEN 100e0 ELSE 0e0 END)") for j in range(5)]
    + [(f"more_1_{j}", f"avg(CASE WHEN r1 >= {j} THEN 100e0 ELSE 0e0 END)") for j in range(2)]
    + [("perf_4", "avg(CASE WHEN r4 >= 4 THEN 100e0 ELSE 0e0 END)"), ("perf_1", "avg(CASE WHEN r1 >= 1 THEN 100e0 ELSE 0e0 END)")]
    + [("vote_4", "avg(CASE WHEN v.vote = q.g THEN 100e0 ELSE 0e0 END)"), ("vote_1", "avg(CASE WHEN v1 = q.g THEN 100e0 ELSE 0e0 END)")]
)


@query("f57_circular_set", CIRCULAR + " UNION ALL ".join(
    f"SELECT q.model, '{m}' AS metric, round({e}, 6) AS score FROM q JOIN n USING (model) JOIN v ON v.qid = q.qid AND v.k = 1 GROUP BY q.model" for m, e in CIRCULAR_METRICS
) + " UNION ALL SELECT model, 'prior_' || CASE c WHEN 'X' THEN '-' ELSE c END, round(avg(CASE WHEN pred = c THEN 100e0 ELSE 0e0 END), 6) FROM s, (VALUES ('A'), ('B'), ('C'), ('D'), ('X')) z(c) GROUP BY model, c")
def _(t):
    return round6(S.circular_set(circular_rows(t), ["model"]))


def circular_rows(t):
    items = t.part.select(
        (F.col("p_size") % 3).alias("model"), F.col("p_partkey").alias("qid"), "p_size",
        F.array(*[F.lit(c) for c in "abcd"]).alias("options"),
        F.substr(F.lit("ABCD"), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1)).alias("gold"),
    )
    rows = P.rotate_options(items)
    rows = rows.withColumn("pos", F.array_position(F.array(*[F.lit(p) for p in P.circular_patterns("ABCD")]), F.col("circular_pattern")))
    number = (F.col("qid") * 7 + F.col("pos") * F.col("pos") * F.col("p_size")) % 5
    return rows.withColumn("pred", F.substr(F.lit("ABCDX"), number.cast("int") + 1, F.lit(1)))


@query("f58_circular_families", CIRCULAR + """
, f AS (SELECT model, qid, ok, 'circular' AS family, 4 AS size FROM s UNION ALL SELECT model, qid, ok, 'origin', 1 FROM s WHERE p = 'ABCD'),
i AS (SELECT model, family, size, qid, sum(ok) AS n, count(*) AS rows_ FROM f GROUP BY ALL)
SELECT model, 'acc_' || family AS metric, round(sum(n) * 100e0 / sum(rows_), 6) AS score FROM i GROUP BY model, family
UNION ALL SELECT model, CASE WHEN j = size THEN 'perf_' || family ELSE 'more_' || CAST(j AS VARCHAR) || '_' || family END, round(avg(CASE WHEN n >= j THEN 100e0 ELSE 0e0 END), 6)
FROM i, (VALUES (1), (2), (3), (4)) x(j) WHERE j <= size GROUP BY model, family, size, j""")
def _(t):
    rows = circular_rows(t).withColumn("right", F.col("pred") == F.col("gold"))
    return round6(S.circular_families(rows, ["model"], {"origin": ["ABCD"], "circular": P.circular_patterns("ABCD")}))


PAIRED = """WITH d AS (SELECT l_returnflag AS task, l_orderkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS q, min(l_partkey % 3) < 2 AS ok FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT task, key, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS v FROM d GROUP BY 1, 2),
a AS (SELECT task, sum(v) / 2e0 / count(*) AS acc, avg(CASE WHEN v = 2 THEN 1e0 ELSE 0e0 END) AS acc_plus FROM k GROUP BY task)
"""


def paired(t):
    q = F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1)
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("task"), F.col("l_orderkey").alias("key"), q.alias("q")).agg(
        (F.min(F.col("l_partkey") % 3) < 2).alias("right")
    )
    return S.paired_image_score(rows.withColumn("model", F.lit("m")), ["model"])


@query("f59_paired_image_score", PAIRED + "SELECT 'm' AS model, task, round(acc, 6) AS acc, round(acc_plus, 6) AS acc_plus, round(100 * (acc + acc_plus), 6) AS score FROM a")
def _(t):
    return round6(paired(t))


@query("f59_group_sums", PAIRED + """
SELECT 'm' AS model, coalesce(CASE WHEN task IN ('A', 'N') THEN 'first' ELSE 'second' END, 'x') AS "group", round(sum(100 * (acc + acc_plus)), 6) AS score FROM a GROUP BY 2
UNION ALL SELECT 'm', 'overall', round(sum(100 * (acc + acc_plus)), 6) FROM a""")
def _(t):
    return round6(S.group_sums(paired(t), ["model"], {"first": ["A", "N"], "second": ["R"]}))


@query("f60_best_of_n", SCORED + """
, d AS (SELECT model, item_id, CASE WHEN difficulty = 'F' THEN 'bon' ELSE 'pair' END AS subset, CASE WHEN item_id % 2 = 0 THEN 'h' ELSE 'n' END AS goal, CASE WHEN answer <= gold THEN 1 ELSE 0 END AS r FROM ev_scored),
x AS (SELECT model, 'bon' AS s, goal, min(r) AS r FROM d WHERE subset = 'bon' GROUP BY model, goal, item_id UNION ALL SELECT model, 'pair', goal, r FROM d WHERE subset = 'pair'),
a AS (SELECT model, avg(r * 100e0) FILTER (s = 'bon' AND goal = 'h') AS bh, avg(r * 100e0) FILTER (s = 'bon' AND goal = 'n') AS bn, avg(r * 100e0) FILTER (s = 'pair' AND goal = 'h') AS ph, avg(r * 100e0) FILTER (s = 'pair' AND goal = 'n') AS pn FROM x GROUP BY model)
SELECT model, round(bh, 6) AS bon_helpfulness, round(bn, 6) AS bon_harmlessness, round(ph, 6) AS pair_helpfulness, round(pn, 6) AS pair_harmlessness, round((bh + bn) / 2, 6) AS bon_average, round((ph + pn) / 2, 6) AS pair_average,
 round((bh + bn + ph + pn) / 4, 6) AS total_accuracy FROM a""")
def _(t):
    rows = t.ev_scored.select(
        "model", F.col("item_id").alias("bon_uid"), F.when(F.col("difficulty") == "F", "bon").otherwise("pair").alias("subset"),
        F.when(F.col("item_id") % 2 == 0, "Helpfulness").otherwise("Harmlessness").alias("goal"), (F.col("answer") <= F.col("gold")).alias("right"),
    )
    return round6(S.best_of_n(rows, ["model"]))


@query("f61_sliced_accuracy", SCORED + """
, s AS (SELECT model, CASE WHEN category = '5-LOW' THEN 'unknown' ELSE category END AS discipline, gold AS field, difficulty, answer = gold AS ok FROM ev_scored)
SELECT model, CASE WHEN grouping(discipline) = 1 THEN '*' ELSE discipline END AS discipline, CASE WHEN grouping(field) = 1 THEN '*' ELSE field END AS field, CASE WHEN grouping(difficulty) = 1 THEN '*' ELSE difficulty END AS difficulty,
 count(*) AS total, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) * 100e0 / count(*), 6) AS accuracy FROM s
GROUP BY GROUPING SETS ((model), (model, difficulty), (model, discipline), (model, discipline, difficulty), (model, discipline, field), (model, discipline, field, difficulty))""")
def _(t):
    rows = t.ev_scored.select(
        "model", F.when(F.col("category") != "5-LOW", F.col("category")).alias("discipline"), F.col("gold").alias("field"),
        "difficulty", (F.col("answer") == F.col("gold")).alias("right"),
    )
    return round6(S.sliced_accuracy(rows, ["model"], ["discipline", "field"], "difficulty"))


# instruction id, arguments, and the same check in SQL for one response x
INSTRUCTIONS = [
    ("punctuation:no_comma", {}, "NOT contains(x, ',')"),
    ("length_constraints:number_words", {"num": "60", "relation": "at least"}, r"len(regexp_extract_all(x, '[\p{L}\p{N}_]+')) >= 60"),
    ("keywords:existence", {"keywords": "de|le"}, "contains(lower(x), 'de') AND contains(lower(x), 'le')"),
    ("keywords:frequency", {"keyword": "the", "num": "3", "relation": "less than"}, "CAST((length(x) - length(replace(lower(x), 'the', ''))) / 3 AS INT) < 3"),
    ("startend:end_checker", {"phrase": "."}, r"ends_with(trim(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '^\"+|\"+$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '.')"),
    ("length_constraints:number_sentences", {"num": "4", "relation": "at least"}, r"len(regexp_extract_all(x, '[^.!?\s][^.!?]*')) >= 4"),
]


def followed_sql(x: str) -> str:
    return "[" + ", ".join(f"({x} ~ '(?s).*[^ ].*') AND ({c.replace('(x', '(' + x).replace('lower(x)', 'lower(' + x + ')')})" for _, _, c in INSTRUCTIONS) + "]"


CUT = "trim(array_to_string(l[{a}:{b}], chr(10)), ' ' || chr(9) || chr(10) || chr(13))"
VARIANTS = "[x, " + ", ".join(CUT.format(a=a, b=b) for a, b in [("2", "len(l)"), ("1", "len(l) - 1"), ("2", "len(l) - 1")]) + "]"


@query("f62_instruction_following", f"""
WITH r AS (SELECT conv_id, turn, role AS model, text AS x, string_split(text, chr(10)) AS l FROM conversations),
b AS (SELECT *, {VARIANTS} AS v4 FROM r), v AS (SELECT conv_id, turn, model, unnest(list_concat(v4, list_transform(v4, lambda y: replace(y, '*', '')))) AS x, x AS orig FROM b),
c AS (SELECT conv_id, turn, model, x = orig AS is_strict, {followed_sql('x')} AS f FROM v),
g AS (SELECT conv_id, turn, model, """ + ", ".join(
    f"bool_or(f[{i + 1}]) FILTER (is_strict) AS s{i}, bool_or(f[{i + 1}]) AS l{i}" for i in range(len(INSTRUCTIONS))
) + """ FROM c GROUP BY 1, 2, 3)
SELECT model, """ + ", ".join(
    f"""round(avg(CASE WHEN {' AND '.join(f'{p}{i}' for i in range(len(INSTRUCTIONS)))} THEN 100e0 ELSE 0e0 END), 6) AS prompt_{n},
 round(sum({' + '.join(f'CASE WHEN {p}{i} THEN 1 ELSE 0 END' for i in range(len(INSTRUCTIONS)))}) * 100e0 / (count(*) * {len(INSTRUCTIONS)}), 6) AS inst_{n}""" for p, n in (("s", "strict"), ("l", "loose"))
) + " FROM g GROUP BY model")
def _(t):
    def struct(name, kwargs):
        pairs = [F.lit(x) for kv in kwargs.items() for x in kv] or [F.lit(""), F.lit("")]
        return F.struct(F.lit(name).alias("id"), F.create_map(*pairs).alias("kwargs"))

    rows = t.conversations.select(
        F.col("role").alias("model"), F.col("text").alias("response"),
        F.array(*[struct(n, k) for n, k, _ in INSTRUCTIONS]).alias("instructions"),
    )
    return round6(I.instruction_following(rows, ["model"], names=[n for n, _, _ in INSTRUCTIONS]))


@query("f63_needle_score", "SELECT lang, " + acc("contains(text, 'tion')") + " AS score FROM documents GROUP BY lang")
def _(t):
    rows = t.documents.select("lang", F.col("text").alias("prediction"), F.lit("tion").alias("keyword"))
    return round6(S.needle_score(rows, ["lang"]))


@query("f63_needle_by_depth", """
WITH n AS (SELECT lang, d, avg(CASE WHEN contains(text, k) THEN 100e0 ELSE 0e0 END) AS s FROM documents, (VALUES ('the', 10), ('und', 50), ('que', 90)) x(k, d) GROUP BY lang, d)
SELECT lang, 'Depth' || CAST(d AS VARCHAR) AS metric, round(s, 6) AS score FROM n UNION ALL SELECT lang, 'average_score', round(avg(s), 6) FROM n GROUP BY lang""")
def _(t):
    needles = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(d).alias("depth")) for k, d in [("the", 10), ("und", 50), ("que", 90)]])
    rows = t.documents.select("lang", F.col("text").alias("prediction"), needles.alias("needles"))
    return round6(S.needle_by_depth(rows, ["lang"]))


NEEDLES = "WITH d AS (SELECT l_returnflag AS model, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'origin' WHEN 1 THEN 'parallel' ELSE 'multi' END AS kind, CAST(l_linenumber AS INT) AS n, l_quantity * 2 AS score FROM lineitem)\n"


def needles(t):
    k = F.col("l_partkey") % 3
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.when(k == 0, "origin").when(k == 1, "parallel").otherwise("multi").alias("kind"),
        F.col("l_linenumber").alias("needle_count"), (F.col("l_quantity") * 2).alias("score"),
        (F.col("l_suppkey") % 3 * 1000).cast("int").alias("length"), (F.col("l_orderkey") % 4 * 25).cast("int").alias("depth"),
    )


@query("f64_composite_needle", NEEDLES + """
, a AS (SELECT model, avg(score) FILTER (kind = 'origin') AS o, avg(score) FILTER (kind = 'parallel') AS p, avg(score) FILTER (kind = 'multi') AS m FROM d GROUP BY model)
SELECT model, round(0.4e0 * o + 0.3e0 * p + 0.3e0 * m, 6) AS score FROM a""")
def _(t):
    return round6(S.composite_needle(needles(t), ["model"]))


@query("f64_heat_map", """
SELECT l_returnflag AS model, CAST(l_orderkey % 4 * 25 AS INT) AS depth, round(avg(l_quantity * 2) FILTER (l_suppkey % 3 = 0), 6) AS "0", round(avg(l_quantity * 2) FILTER (l_suppkey % 3 = 1), 6) AS "1000",
 round(avg(l_quantity * 2) FILTER (l_suppkey % 3 = 2), 6) AS "2000" FROM lineitem GROUP BY 1, 2""")
def _(t):
    return round6(S.heat_map(needles(t), ["model"], [0, 1000, 2000]))


@query("f65_longest_tolerable", """
WITH a AS (SELECT l_returnflag AS model, l_partkey % 40 AS setting, l_linenumber AS c, avg(l_quantity * 2) AS s FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT *, s < 50 AS low, coalesce(lag(c) OVER z, 0) AS prev, coalesce(lag(s < 50) OVER z, false) AS was FROM a WINDOW z AS (PARTITION BY model, setting ORDER BY c))
SELECT model, setting, CAST(coalesce(arg_max(prev, c) FILTER (low AND NOT was), max(c)) AS INT) AS max_needles FROM w GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"), (F.col("l_partkey") % 40).alias("setting"),
        F.col("l_linenumber").alias("needle_count"), (F.col("l_quantity") * 2).alias("score"),
    )
    return S.longest_tolerable(rows, ["model", "setting"], floor=50.0)


@query("f66_toxicity_summary", """
WITH s AS (SELECT lang, CASE WHEN l.doc_id IS NULL THEN -1e0 ELSE toxic * 0.6e0 + quality * 0.1e0 END AS x FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, round(max(x) FILTER (x >= 0), 4) AS expected_max_toxicity, round(count(*) FILTER (x >= 0) * 1e0 / count(*), 4) AS valid_frac, round(count(*) FILTER (x >= 0.5) * 1e0 / count(*) FILTER (x >= 0), 4) AS toxic_frac_valid,
 round(avg(x) FILTER (x >= 0), 4) AS avg_toxicity_score FROM s GROUP BY lang""")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    score = F.coalesce(F.col("toxic") * 0.6 + F.col("quality") * 0.1, F.lit(-1.0))
    return S.toxicity_summary(rows.withColumn("toxicity_score", score), ["lang"])


@query("f67_prompt_robustness", SCORED + """
, a AS (SELECT model, category AS prompt, avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) AS s FROM ev_scored GROUP BY 1, 2)
SELECT model, prompt, round(s, 6) AS accuracy, CAST(row_number() OVER (PARTITION BY model ORDER BY s DESC, prompt) AS INT) AS place, s = min(s) OVER (PARTITION BY model) AS worst,
 round((max(s) OVER (PARTITION BY model) - s) / max(s) OVER (PARTITION BY model), 6) AS "drop" FROM a""")
def _(t):
    rows = t.ev_scored.select("model", F.col("category").alias("prompt"), (F.col("answer") == F.col("gold")).alias("right"))
    return round6(S.prompt_robustness(rows, ["model"]))


@query("f68_anomaly_rates", with_tables("ev_text_pairs") + r"""
SELECT model, min(prediction) = max(prediction) AS same_response, round(avg(CASE WHEN regexp_matches(prediction, '[éèêçäöüß]') THEN 1e0 ELSE 0e0 END), 6) AS language_inconsistency,
 round(avg(CASE WHEN NOT regexp_matches(prediction, '\.\s*$') THEN 1e0 ELSE 0e0 END), 6) AS off_format, round(avg(CASE WHEN trim(prediction, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND contains(reference, trim(prediction, ' ' || chr(9) || chr(10) || chr(13))) THEN 1e0 ELSE 0e0 END), 6) AS repetition,
 round(avg(CASE WHEN trim(prediction, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1e0 ELSE 0e0 END), 6) AS empty_response FROM ev_text_pairs GROUP BY model""")
def _(t):
    foreign = F.regexp_like("prediction", F.lit("[éèêçäöüß]"))
    off = ~F.regexp_like("prediction", F.lit(r"\.\s*$"))
    return round6(S.anomaly_rates(t.ev_text_pairs, ["model"], foreign, off, prompt="reference"))
