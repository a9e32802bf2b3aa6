"""Queries over readers and writers. Files are first written from the given tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import leaderboard as L
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6
from evalmill.session import pin, scratch_path
from evalmill.sources import readers as R
from evalmill.sources import writers as W

ITEMS = with_tables("ev_items")


@query("a1_read_items_jsonl", ITEMS + "SELECT item_id, gold, category, difficulty, price FROM ev_items")
def _(t):
    path = scratch_path(t.spark, "items")
    t.ev_items.select("item_id", "gold", "category", "difficulty", "price").write.json(path)
    return R.read_items(t.spark, path, "jsonl", "item_id bigint, gold string, category string, difficulty string, price double")


@query("a1_read_items_csv", "SELECT doc_id, text FROM documents")
def _(t):
    path = scratch_path(t.spark, "items")
    t.documents.select("doc_id", "text").write.csv(path, header=True, escape='"', quoteAll=True)
    return R.read_items(t.spark, path, "csv", "doc_id bigint, text string")


@query("a2_read_subject_files", """
SELECT p_name AS input, p_brand AS "A", p_type AS "B", CAST(p_size AS VARCHAR) AS "C", 'none' AS "D", substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS target,
 lower(p_type) AS subject, 'test' AS split FROM part""")
def _(t):
    folder = scratch_path(t.spark, "subjects")
    rows = t.part.select(
        F.concat(F.lower("p_type"), F.lit("_test.csv")).alias("file"),
        F.concat_ws(
            ",", *[F.concat(F.lit('"'), c.cast("string"), F.lit('"')) for c in [
                F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.lit("none"),
                F.substr(F.lit("ABCD"), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1))]]
        ).alias("value"),
    )
    # one csv file per subject, written by Spark under <subject>_test.csv/
    rows.write.partitionBy("file").text(folder)
    return R.read_subject_files(t.spark, folder, "test")


@query("a3_read_nested_qa", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'conversation ' || CAST(conv_id AS VARCHAR) AS context, text AS question,
 role <> 'assistant' AS is_impossible, CASE WHEN role <> 'assistant' THEN role || '|impossible to answer' ELSE text END AS answers FROM conversations""")
def _(t):
    qa = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text").alias("question"),
        (F.col("role") != "assistant").alias("is_impossible"),
        F.array(F.struct("text"), F.struct("text")).alias("answers"),
        F.array(F.struct(F.col("role").alias("text"))).alias("plausible_answers"),
    )
    paragraph = F.struct(F.concat(F.lit("conversation "), "conv_id").alias("context"), F.col("qas"))
    rows = t.conversations.groupBy("conv_id").agg(F.collect_list(qa).alias("qas"))
    path = scratch_path(t.spark, "nested")
    rows.select(F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data")).write.json(path)
    return R.read_nested_qa(t.spark, path, whole_file=False).withColumn("answers", F.array_join("answers", "|"))


@query("a4_read_columnar", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(t):
    return R.read_columnar(t.spark, f"{t.path}/documents.parquet").select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))


@query("a5_read_prediction_shards", with_tables("ev_items") + """
, n AS (SELECT *, CAST(item_id % 8 AS INT) AS shard FROM ev_items),
s AS (SELECT *, row_number() OVER (ORDER BY shard, item_id) - 1 AS position FROM n)
SELECT position, 'Q' || CAST(item_id AS VARCHAR) AS origin_prompt, category AS prediction, gold FROM s WHERE shard < 6""")
def _(t):
    folder = scratch_path(t.spark, "shards")
    from evalmill.operators.ordering import running

    shard = (F.col("item_id") % 8).cast("int")
    rows = running(t.ev_items.withColumn("shard", shard), ["shard"], F.col("item_id"), F.col("item_id"))
    entry = F.struct(
        (F.col("rank") - 1).cast("string").alias("key"),
        F.struct(
            F.concat(F.lit("Q"), "item_id").alias("origin_prompt"), F.col("category").alias("prediction"), "gold"
        ).alias("value"),
    )
    # the shard format is one JSON object per file, so each shard is one row here
    files = rows.filter("shard <> 6").groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    named = files.withColumn("file", F.concat(F.lit("preds_"), "shard", F.lit(".json"))).drop("shard")
    named.write.partitionBy("file").text(folder)
    return R.read_prediction_shards(t.spark, f"{folder}/file=preds_*.json")


ARENA = r"regexp_extract(verdict_text, '\[\[([AB<>=]+)\]\]', 1)"


@query("a7_parse_judgements", with_tables("ev_judgements") + f"""
SELECT judge, item_id, model_a, model_b, {ARENA} AS verdict FROM ev_judgements WHERE {ARENA} <> ''""")
def _(t):
    return R.parse_judgements(t.ev_judgements, E.verdict("arena")).select("judge", "item_id", "model_a", "model_b", "verdict")


@query("a7_parse_rate", with_tables("ev_judgements") + f"""
SELECT judge, capability, count(*) AS judgements, round(avg(CASE WHEN {ARENA} <> '' THEN 1e0 ELSE 0e0 END), 6) AS parsed,
 avg(CASE WHEN {ARENA} <> '' THEN 1e0 ELSE 0e0 END) <= 0.95 AS warn FROM ev_judgements GROUP BY judge, capability""")
def _(t):
    return round6(R.parse_rate(t.ev_judgements, E.verdict("arena"), ["judge", "capability"]))


RESULTS = with_tables("ev_results")


@query("a8_write_results", RESULTS + "SELECT model, dataset, metric, round(score, 6) AS score FROM ev_results")
def _(t):
    path = scratch_path(t.spark, "results")
    W.write_results(t.ev_results, path, "json")
    back = t.spark.read.schema("metric string, score double, model string, dataset string").json(path)
    return round6(back.select("model", "dataset", "metric", "score"))


def details(t):
    texts = t.ev_scored.select("model", F.col("category").alias("dataset"), F.concat_ws("-", "item_id", "pos").alias("item_id"), F.lit("Pick one.").alias("prompt"), "prediction",
                               F.when(F.col("prediction").contains("not sure"), None).otherwise(F.col("answer")).alias("answer"), "gold", F.lit(None).cast("map<string,double>").alias("labels"))
    losses = t.ev_label_scores.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "nll")))).alias("labels"), F.min_by("label", F.struct("nll", "label")).alias("answer"))
    ranked = losses.join(t.ev_items.select("item_id", "gold"), "item_id").select(
        F.lit("ranked").alias("model"), F.lit("labels").alias("dataset"), F.col("item_id").cast("string").alias("item_id"), F.lit("Pick one.").alias("prompt"), F.lit(None).cast("string").alias("prediction"), "answer", "gold", "labels"
    )
    path = scratch_path(t.spark, "details")
    W.write_details(W.item_details(texts.unionByName(ranked)), path)
    return t.spark.read.parquet(path)


DETAILS = with_tables("ev_scored", "ev_label_scores") + """
, d AS (SELECT model, category AS dataset, item_id || '-' || pos AS item_id, 'GEN' AS type, prediction AS origin_prediction, CASE WHEN NOT contains(prediction, 'not sure') THEN answer END AS predictions, gold, NULL AS labels FROM ev_scored
 UNION ALL SELECT 'ranked', 'labels', CAST(item_id AS VARCHAR), 'PPL', NULL, arg_min(label, {'n': nll, 'l': label}), any_value(gold), string_agg(label || '=' || round(nll, 4), ',' ORDER BY label)
 FROM ev_label_scores JOIN ev_items USING (item_id) GROUP BY item_id)
"""


@query("a8_write_details", DETAILS + """
SELECT model, dataset, item_id, type, 'Pick one.' AS prompt, origin_prediction, labels, predictions, gold AS "references", coalesce(predictions = gold, false) AS correct FROM d""")
def _(t):
    d = details(t).select("model", "dataset", "item_id", "detail.*")
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 4)))
    return d.withColumn("labels", F.array_join(pairs, ","))


@query("a8_extraction_rates", DETAILS + """
SELECT model, dataset, round(avg(CASE WHEN predictions IS NOT NULL THEN 100e0 ELSE 0e0 END), 6) AS extraction_rate, round(avg(CASE WHEN predictions = gold THEN 100e0 ELSE 0e0 END), 6) AS accuracy
FROM d GROUP BY model, dataset""")
def _(t):
    return round6(W.extraction_rates(details(t)))


@query("a9_write_leaderboard", RESULTS + """
, w AS (SELECT dataset, """ + ", ".join(
    f"printf('%.2f', round(max(score) FILTER (model = 'm{i}'), 2)) AS m{i}" for i in range(5)
) + """ FROM ev_results WHERE metric = 'accuracy' GROUP BY dataset)
SELECT '| ' || dataset || ' | accuracy | ' || m0 || ' | ' || m1 || ' | ' || m2 || ' | ' || m3 || ' | ' || m4 || ' |' AS value FROM w
UNION ALL SELECT '| dataset | metric | m0 | m1 | m2 | m3 | m4 |' UNION ALL SELECT '|---|---|---|---|---|---|---|'""")
def _(t):
    board = L.pivot_models(t.ev_results.filter("metric = 'accuracy'"), [f"m{i}" for i in range(5)])
    path = scratch_path(t.spark, "board")
    W.write_leaderboard(board, path, "markdown")
    return t.spark.read.text(path)


BOARD_SQL = RESULTS + """
, w AS (SELECT dataset, """ + ", ".join(
    f"printf('%.2f', round(max(score) FILTER (model = 'm{i}'), 2)) AS m{i}" for i in range(5)
) + """ FROM ev_results WHERE metric = 'accuracy' GROUP BY dataset)
"""


@query("a9_write_leaderboard_csv", BOARD_SQL + "SELECT dataset, 'accuracy' AS metric, m0, m1, m2, m3, m4 FROM w")
def _(t):
    board = L.pivot_models(t.ev_results.filter("metric = 'accuracy'"), [f"m{i}" for i in range(5)])
    path = scratch_path(t.spark, "board")
    W.write_leaderboard(board, path, "csv")
    return t.spark.read.csv(path, header=True)


@query("a9_write_leaderboard_text", BOARD_SQL + """
, c AS (SELECT * FROM w UNION ALL SELECT 'dataset', 'm0', 'm1', 'm2', 'm3', 'm4'),
s AS (SELECT max(length(dataset))::INT AS d, max(length(m0))::INT AS w0, max(length(m1))::INT AS w1, max(length(m2))::INT AS w2, max(length(m3))::INT AS w3 FROM c)
SELECT rpad(dataset, d, ' ') || ' ' || CASE WHEN dataset = 'dataset' THEN 'metric  ' ELSE 'accuracy' END || ' ' || rpad(m0, w0, ' ') || ' ' || rpad(m1, w1, ' ')
 || ' ' || rpad(m2, w2, ' ') || ' ' || rpad(m3, w3, ' ') || ' ' || m4 AS value FROM c, s""")
def _(t):
    board = L.pivot_models(t.ev_results.filter("metric = 'accuracy'"), [f"m{i}" for i in range(5)])
    path = scratch_path(t.spark, "board")
    W.write_leaderboard(board, path, "text")
    return t.spark.read.text(path)


@query("a10_result_store", RESULTS + """
SELECT model, dataset, metric, round(CASE WHEN model = 'm0' AND dataset = '5-LOW' THEN score + 1 WHEN dataset = '2-HIGH' THEN -1e0 ELSE score END, 6) AS score FROM ev_results""")
def _(t):
    store = W.ResultStore(t.spark, scratch_path(t.spark, "store"))
    results = pin(t.ev_results)
    store.publish(results.filter("model = 'm0' and dataset = '5-LOW'").withColumn("score", F.col("score") + 1))
    store.publish(results)
    store.publish(results.filter("dataset = '2-HIGH'").withColumn("score", F.lit(-1.0)), overwrite=True)
    return round6(store.lookup().select("model", "dataset", "metric", "score"))
