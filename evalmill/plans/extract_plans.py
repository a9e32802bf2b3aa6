"""Queries over extraction rules, on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import GENERAL, QA_NORM

PREDS = with_tables("ev_predictions")
KEYS = ["model", "item_id", "pos"]


def on_predictions(t, rule, text=None):
    rows = t.wide("ev_predictions") if text is None else t.wide("ev_predictions").withColumn("prediction", text)
    return E.extract(rows.drop("answer"), rule).select(*KEYS, "answer")


def on_documents(t, rule, text=None):
    rows = t.documents.select("doc_id", (F.col("text") if text is None else text).alias("prediction"))
    return E.extract(rows, rule).select("doc_id", "answer")


def PRED_SQL(expr: str, text: str = "prediction") -> str:
    return PREDS + f", s AS (SELECT model, item_id, pos, {text} AS x FROM ev_predictions) SELECT model, item_id, pos, {expr} AS answer FROM s"


def DOC_SQL(expr: str, text: str = "text") -> str:
    return f"WITH s AS (SELECT doc_id, {text} AS x FROM documents) SELECT doc_id, {expr} AS answer FROM s"


@query("e1_general", DOC_SQL(GENERAL("x")))
def _(t):
    return on_documents(t, E.general)


@query("e2_capitals", DOC_SQL(r"""regexp_extract(x, '\p{Lu}') || '|' || coalesce(regexp_extract_all(x, '\p{Lu}')[-1], '') || '|' || regexp_extract(x, '[A-D]+')
 || '|' || array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\p{Lu}'))), '')"""))
def _(t):
    return on_documents(
        t, lambda x: F.concat_ws("|", E.first_capital(x), E.last_capital(x), E.first_run(x), E.capital_set(x))
    )


@query("e3_first_option", PRED_SQL("""CASE WHEN x LIKE '%The answer is (%' THEN regexp_extract(x, 'answer is \\(([A-D])', 1)
 WHEN x LIKE '%the answer is %' THEN regexp_extract(x, 'the answer is ([A-D])', 1) WHEN x LIKE '答案%' THEN regexp_extract(x, '([A-D])', 1) WHEN regexp_matches(x, '^[A-D]$') THEN x ELSE '' END""",
 "CASE WHEN pos % 5 = 0 THEN '答案选 ' || answer || '。' ELSE prediction END"))
def _(t):
    text = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("答案选 "), "answer", F.lit("。"))).otherwise(F.col("prediction"))
    rows = t.wide("ev_predictions").withColumn("prediction", text).drop("answer")
    return E.extract(rows, E.first_option("ABCD")).select(*KEYS, "answer")


@query("e3_last_option", DOC_SQL("coalesce(regexp_extract_all(x, '[ABCD]')[-1], '')"))
def _(t):
    return on_documents(t, E.last_option("ABCD"))


@query("e4_numbers", PRED_SQL("""CASE WHEN regexp_matches(x, '(?i)the answer is[:\\s]*(-?\\d+(?:\\.\\d+)?)') THEN regexp_extract(x, '(?i)the answer is[:\\s]*(-?\\d+(?:\\.\\d+)?)', 1)
 ELSE coalesce(regexp_extract_all(split_part(x, 'Question:', 1), '-?\\d+\\.\\d+|-?\\d+')[-1], 'NULL') END""",
 "prediction || CASE WHEN item_id % 2 = 0 THEN ' The Answer is: -' || CAST(item_id AS VARCHAR) || '.5' ELSE '' END || ' Question: 99'"))
def _(t):
    stated = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" The Answer is: -"), "item_id", F.lit(".5"))).otherwise("")
    return on_predictions(t, E.last_number, F.concat("prediction", stated, F.lit(" Question: 99")))


@query("e4_first_number", DOC_SQL(r"TRY_CAST(nullif(regexp_extract(x, '-?\d*\.?\d+'), '') AS DOUBLE)"))
def _(t):
    return on_documents(t, E.first_number)


@query("e5_last_boxed", PRED_SQL("'\\frac{' || CAST(item_id AS VARCHAR) || '}{{' || model || '}}'"))
def _(t):
    text = F.concat(
        "prediction", F.lit("\\boxed{7} then \\boxed{\\frac{"), "item_id", F.lit("}{{"), "model", F.lit("}}} done}")
    )
    return on_predictions(t, E.last_boxed, text)


@query("e6_final_answer", PRED_SQL("CASE WHEN pos % 2 = 0 THEN CAST(item_id AS VARCHAR) ELSE CAST(item_id AS VARCHAR) || '000' END"))
def _(t):
    boxed = F.concat(F.lit("We get \\boxed{"), "item_id", F.lit("}. Done"))
    plain = F.concat(F.lit("So we add. The final answer is $"), "item_id", F.lit(",000$ dollars. I hope"))
    return on_predictions(t, E.final_answer, F.when(F.col("pos") % 2 == 0, boxed).otherwise(plain))


AFTER = "CASE WHEN contains(x, 'answer is ') THEN trim(string_split(x, 'answer is ')[2], ' ' || chr(9) || chr(10) || chr(13)) ELSE x END"


@query("e7_answer_choice", PRED_SQL(f"""CASE WHEN regexp_matches({AFTER}, '\\(([A-Z])\\)*') THEN regexp_extract({AFTER}, '\\(([A-Z])\\)*', 1)
 WHEN regexp_matches({AFTER}, '[A-Z]') THEN regexp_extract({AFTER}, '([A-Z])', 1) ELSE {AFTER} END"""))
def _(t):
    return on_predictions(t, E.answer_choice)


@query("e7_answer_freeform", PRED_SQL(f"""CASE WHEN regexp_matches({AFTER}, '\\*\\*(.*?)\\*\\*') THEN regexp_extract({AFTER}, '\\*\\*(.*?)\\*\\*', 1)
 ELSE trim(regexp_replace(trim(split_part({AFTER}, chr(10), 1), ' ' || chr(9) || chr(10) || chr(13)), '\\.$', ''), ' ' || chr(9) || chr(10) || chr(13)) END""", "CASE WHEN item_id % 3 = 0 THEN 'answer is **' || model || '** ok' ELSE prediction END"))
def _(t):
    bold = F.concat(F.lit("answer is **"), "model", F.lit("** ok"))
    return on_predictions(t, E.answer_freeform, F.when(F.col("item_id") % 3 == 0, bold).otherwise(F.col("prediction")))


@query("e8_xml_tag", """
WITH s AS (SELECT page_id, html AS x FROM pages)
SELECT page_id, coalesce(trim(regexp_extract_all(x, '(?s)<p>(.*?)</p>', 1)[-1], ' ' || chr(9) || chr(10) || chr(13)), 'NO ANSWER FOUND') AS answer FROM s""")
def _(t):
    return E.extract(t.pages.withColumnRenamed("html", "prediction"), E.xml_tag("p")).select("page_id", "answer")


@query("e9_strip_reasoning", DOC_SQL("""trim(CASE WHEN NOT contains(x, '<think>') AND contains(x, '</think>') THEN string_split(x, '</think>')[-1]
 ELSE regexp_replace(x, '(?s)<think>.*?</think>', '', 'g') END, ' ' || chr(9) || chr(10) || chr(13))""",
 "CASE WHEN doc_id % 3 = 0 THEN text || '</think> ' || source WHEN doc_id % 3 = 1 THEN 'a <think>' || text || '</think> b <think>' || lang || '</think> c ' ELSE text END"))
def _(t):
    k = F.col("doc_id") % 3
    text = (
        F.when(k == 0, F.concat("text", F.lit("</think> "), "source"))
        .when(k == 1, F.concat(F.lit("a <think>"), "text", F.lit("</think> b <think>"), "lang", F.lit("</think> c ")))
        .otherwise(F.col("text"))
    )
    return on_documents(t, E.strip_reasoning(), text)


@query("e10_regex_group", PRED_SQL("CASE WHEN regexp_matches(x, 'Cost (\\d+)') THEN trim(regexp_extract(x, 'Cost (\\d+)', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE x END"))
def _(t):
    return on_predictions(t, E.regex_group(r"Cost (\d+)"))


@query("e11_role_span", DOC_SQL("""split_part(CASE WHEN contains(x, '<bot>') THEN substr(x, strpos(x, '<bot>') + 5) ELSE x END, '<eot>', 1)""",
 "source || CASE WHEN doc_id % 2 = 0 THEN '<bot>' ELSE '' END || text || '<eot>' || lang"))
def _(t):
    mark = F.when(F.col("doc_id") % 2 == 0, "<bot>").otherwise("")
    return on_documents(t, E.role_span("<bot>", "<eot>"), F.concat("source", mark, "text", F.lit("<eot>"), "lang"))


@query("e12_code_block", DOC_SQL("""CASE WHEN regexp_matches(x, '(?s)```[^\\n`]*\\n(.*?)```') THEN regexp_extract(x, '(?s)```[^\\n`]*\\n(.*?)```', 1) ELSE x END""",
 "CASE WHEN doc_id % 2 = 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '``` and ```' ELSE text END"))
def _(t):
    fenced = F.concat(F.lit("Sure:\n```python\n"), "text", F.lit("\n``` and ```"))
    return on_documents(t, E.code_block, F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text")))


@query("e13_verdicts", with_tables("ev_judgements") + """
SELECT judge, item_id, model_a, model_b, nullif(regexp_extract(verdict_text, '\\[\\[([AB<>=]+)\\]\\]', 1), '') AS arena, CASE WHEN model_a = 'm6' THEN NULL ELSE 'B' END AS choice,
 CAST(CAST(substr(model_a, 2) AS INT) + 0.5 AS VARCHAR) AS rating, 'M' AS letter, 'A++' AS json_choice, substr(model_b, 2) AS json_score, CASE WHEN judge = 'j0' THEN 'A' ELSE 'C' END AS grade,
 CASE WHEN judge = 'j1' THEN 'B' WHEN judge = 'j2' THEN 'A' END AS winner FROM ev_judgements""")
def _(t):
    number = F.substr("model_a", F.lit(2))
    rows = t.wide("ev_judgements")
    texts = {
        "arena": F.col("verdict_text"),
        "choice": F.when(F.col("model_a") == "m6", "Choice: none").otherwise("Choice: B, clearly"),
        "rating": F.concat(F.lit("Rating: [["), number, F.lit(".5]] of 10")),
        "letter": F.lit("M is better than m"),
        "json_choice": F.lit('{"choice": "A++", "why": "x"}'),
        "json_score": F.concat(F.lit('{"score": "'), F.substr("model_b", F.lit(2)), F.lit('"}')),
        "grade": F.when(F.col("judge") == "j0", "A: right").otherwise("not sure"),
        "winner": F.when(F.col("judge") == "j1", '{"winner":"A"} no, {"winner":"B"}').when(F.col("judge") == "j2", '"winner": "A"').otherwise("none"),
    }
    return rows.select("judge", "item_id", "model_a", "model_b", *[E.verdict(k)(v).alias(k) for k, v in texts.items()])


@query("e14_checklist_scores", with_tables("ev_judgements") + """
SELECT judge, item_id, model_a, model_b, CASE WHEN model_a <> 'm5' AND judge <> 'j2' THEN '[' || printf('%.2f', difficulty_points / 100e0) || ',0.50]' END AS scores FROM ev_judgements""")
def _(t):
    score = F.when(F.col("model_a") == "m5", F.lit(1.5)).otherwise(F.col("difficulty_points") / 100)
    text = F.concat(
        F.lit('```json\n[{"checklist_id": 0, "evaluation_score": '), score.cast("string"),
        F.lit('}, {"checklist_id": 1, "evaluation_score": 0.5}'), F.when(F.col("judge") == "j2", "").otherwise("]"), F.lit("\n```"),
    )
    rows = E.extract(t.wide("ev_judgements").withColumn("verdict_text", text), E.checklist_scores(2), "verdict_text", "scores")
    listed = F.concat(F.lit("["), F.array_join(F.transform("scores", lambda s: F.format_string("%.2f", s)), ","), F.lit("]"))
    return rows.select("judge", "item_id", "model_a", "model_b", F.when(F.col("scores").isNotNull(), listed).alias("scores"))


@query("e15_entity_maps", ENTITY_SQL := with_tables("ev_items") + """
SELECT item_id, category AS gold_priority, difficulty AS gold_status, CASE WHEN item_id % 3 <> 0 THEN split_part(category, ' ', 1) END AS said_priority, CASE WHEN item_id % 4 <> 0 THEN 'F' END AS said_status FROM ev_items""")
def _(t):
    return entities(t).select(
        "item_id", F.col("gold")["priority"].alias("gold_priority"), F.col("gold")["status"].alias("gold_status"),
        F.col("said")["priority"].alias("said_priority"), F.col("said")["status"].alias("said_status"),
    )


def entities(t):
    gold = F.concat(F.lit("priority:"), "category", F.lit(";status:"), "difficulty")
    said = F.concat(
        F.lit("priority:"), F.when(F.col("item_id") % 3 == 0, "无").otherwise(F.col("category")),
        F.lit("\nstatus: "), F.when(F.col("item_id") % 4 == 0, "未提及").otherwise("F"), F.lit(" \nend"),
    )
    return t.wide("ev_items").select(
        "item_id", E.gold_entities(gold).alias("gold"), E.predicted_entities(["priority", "status"])(said).alias("said")
    )


@query("e16_qa_normalise", DOC_SQL(QA_NORM("x")))
def _(t):
    return on_documents(t, E.qa_normalise)


@query("e17_chain", PREDS + """
, s AS (SELECT model, item_id, [prediction, '<think>A</think> ' || answer] AS xs FROM ev_predictions),
z AS (SELECT model, item_id, list_transform(xs, lambda x: regexp_extract(trim(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '[A-D]+')) AS a FROM s)
SELECT model, item_id, a[1] || '|' || a[2] AS answer FROM z""")
def _(t):
    rows = t.wide("ev_predictions").withColumn(
        "prediction", F.array("prediction", F.concat(F.lit("<think>A</think> "), "answer"))
    ).drop("answer")
    out = E.extract(rows, E.chain(E.strip_reasoning(), E.first_run))
    return out.select("model", "item_id", F.array_join("answer", "|").alias("answer"))
