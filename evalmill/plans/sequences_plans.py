"""Queries over token sequences, synthetic sets, the model boundary and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from evalmill import registry
from evalmill.functions.draws import below
from evalmill.functions.text import words
from evalmill.operators import model as M
from evalmill.operators import sequences as Q
from evalmill.operators import synthetic as Y
from evalmill.plans import draws_sql as D
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables
from evalmill.plans.sql import round6
from evalmill.session import pin, scratch_path
from evalmill.streaming import scoring as S

# own tokens: a number drawn for the word, below the mask token's id
def token_ids(text):
    return F.transform(words(text), lambda w: below(Q.MASK_ID, 0, w).cast("int"))


def seqs(t):
    return t.documents.select(F.col("doc_id").alias("seq_id"), token_ids(F.col("text")).alias("input_ids"))


@query("h1_mask_tokens", D.MASK_TOKENS)
def _(t):
    return Q.mask_tokens(seqs(t))


@query("h2_truncate_random", D.TRUNCATED)
def _(t):
    return Q.truncate_random(seqs(t), seed=3)


@query("h3_sft_rows", D.SFT_ROWS)
def _(t):
    rows = t.ev_text_pairs.select(
        F.col("pair_id").alias("seq_id"), token_ids(F.col("reference")).alias("prompt_ids"), token_ids(F.col("prediction")).alias("answer_ids")
    )
    return Q.sft_rows(rows, 512, eos_id=126081)


@query("h4_stratified_masks", D.STRATIFIED)
def _(t):
    rows = t.ev_text_pairs.select(
        F.col("pair_id").alias("item_id"), F.size(words(F.col("reference"))).alias("prompt_length"), F.size(words(F.col("prediction"))).alias("target_length")
    )
    return Q.stratified_masks(rows.filter("target_length > 0"), 8)


@query("h5_unmask_schedule", """
SELECT doc_id AS seq_id, CAST(s AS INT) AS step, CAST(n_chars // 16 + CASE WHEN s < n_chars % 16 THEN 1 ELSE 0 END AS BIGINT) AS reveal FROM documents, range(16) x(s)""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("seq_id"), F.col("n_chars").alias("masked"))
    return Q.unmask_schedule(rows, 16).select("seq_id", "step", "reveal")


@query("h6_continuation_probes", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS k FROM documents),
e AS (SELECT doc_id, k, i, 2 + (i * (CASE WHEN len(k) >= 10 THEN len(k) - 5 ELSE greatest(len(k), 2) END - 2)) // 4 AS c FROM d, range(5) x(i))
SELECT doc_id, CAST(i AS INT) AS probe, CAST(c AS INT) AS cut, array_to_string(k[1:c], ' ') AS prompt, array_to_string(k[c + 1:c + 5], ' ') AS reference FROM e""")
def _(t):
    return Q.continuation_probes(t.documents.select("doc_id", words(F.col("text")).alias("tokens")), 5, 5)


def word_docs(t):
    return t.documents.select("doc_id", words(F.col("text")).alias("tokens"))


def needles(t, repeats):
    per = t.orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("price"))
    status = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    rows = t.spark.range(repeats).select(F.col("id").cast("int").alias("repeat"), F.get(status, F.pmod("id", F.lit(3)).cast("int")).alias("o_orderstatus"))
    text = F.concat_ws(" ", F.lit("the dearest order of status"), "o_orderstatus", F.lit("costs"), "price")
    return rows.join(per, "o_orderstatus").select(
        "repeat", F.split(text, " ").alias("needle"), F.concat(F.lit("What does the dearest order of status "), "o_orderstatus", F.lit(" cost?")).alias("question"),
        F.col("price").cast("string").alias("keyword"),
    )


@query("h7_needle_haystack", D.NEEDLE)
def _(t):
    return Y.needle_haystack(word_docs(t), needles(t, 3), [500, 1000, 2000], [0, 25, 50, 75, 100], 3, buffer=50)


@query("h8_multi_needle", D.MULTI_NEEDLE)
def _(t):
    stacks = Y.haystacks(word_docs(t), 1000, 3).join(needles(t, 3), "repeat")
    rows = stacks.withColumn("needles", F.array("needle", F.array(F.lit("second"), F.lit("needle")), F.array(F.lit("third"), F.lit("needle"))))
    return Y.multi_needle(rows, 20, 10).select("repeat", "context", "keyword")


@query("h8_parallel_needles", D.PARALLEL_NEEDLES)
def _(t):
    stacks = Y.haystacks(word_docs(t), 1000, 3).join(needles(t, 3), "repeat")
    rows = stacks.withColumn("needles", F.array("needle", F.array(F.lit("second"), F.lit("needle")))).withColumn(
        "keywords", F.array(F.col("keyword"), F.lit("second"))
    )
    return Y.parallel_needles(rows, [10, 90]).select("repeat", "context", "answer")


def short_items(t):
    return t.benchmark.select("item_id")


@query("h9_kinship_chains", D.KINSHIP)
def _(t):
    names = sorted(r["n_name"] for r in t.nation.select("n_name").collect())
    return Y.kinship_chains(t.orders.select(F.col("o_orderkey").alias("item_id")), names, 6).drop("chain")


def sentences(t):
    lines = F.filter(F.split("text", r"[.\n]\s*"), lambda s: s != "")
    return t.benchmark.select("item_id", lines.alias("lines"))


@query("h10_key_value_needles", D.key_value(False))
def _(t):
    return Y.key_value_needles(sentences(t), F.col("lines"), 60)


@query("h10_key_value_decoys", D.key_value(True))
def _(t):
    return Y.key_value_needles(sentences(t), F.col("lines"), 60, decoys=True)


@query("h11_variable_chains", D.VARIABLE_CHAINS)
def _(t):
    return Y.variable_chains(short_items(t), "The grass is green.", 40, chains=2)


def vocabulary(t):
    return pin(Y.word_vocabulary(word_docs(t)))


@query("h12_common_words", D.COMMON_WORDS)
def _(t):
    return Y.common_words(short_items(t), vocabulary(t))


@query("h12_frequent_words", D.FREQUENT_WORDS)
def _(t):
    return Y.frequent_words(short_items(t), vocabulary(t))


@query("h13_distractor_qa", D.DISTRACTORS)
def _(t):
    docs = t.documents.select("doc_id", "text", F.size(words(F.col("text"))).alias("n_tokens"))
    gold = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    questions = gold.select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("Which source is "), "source", F.lit("?")).alias("question"),
        F.col("source").alias("answer"), F.array("doc_id").alias("gold"),
    )
    return Y.distractor_qa(questions, docs, 4000)


def _load_length_model():
    """Stands in for a model: word count of the prompt; refuses prompts that end without a full stop."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        if not batch["text"].str.endswith(".").all():
            raise ValueError("no full stop")
        return pd.DataFrame({"n_words": batch["text"].str.split(" ").str.len(), "first": batch["text"].str[:1]})

    return run


@query("h14_score_with_model", """
SELECT conv_id, turn, CAST(s AS INT) AS sample_id, CASE WHEN ends_with(text, '.') THEN len(string_split(text, ' ')) END AS n_words, CASE WHEN ends_with(text, '.') THEN substr(text, 1, 1) END AS first,
 CASE WHEN NOT ends_with(text, '.') THEN 'no full stop' END AS error FROM conversations, range(2) x(s)""")
def _(t):
    out = M.score_with_model(t.conversations, _load_length_model, "n_words bigint, first string", batch=16, samples=2)
    return out.select("conv_id", "turn", "sample_id", "n_words", "first", "error")


@query("h16_resume", with_tables("ev_items") + "SELECT item_id, CASE WHEN difficulty = 'F' THEN 'first run' ELSE 'second run' END AS run FROM ev_items")
def _(t):
    path = scratch_path(t.spark, "resume")
    tasks = t.ev_items.select("item_id", "difficulty")
    M.resume(tasks.filter("difficulty = 'F'"), path, ["item_id"], lambda df: df.select("item_id", F.lit("first run").alias("run")))
    return M.resume(tasks, path, ["item_id"], lambda df: df.select("item_id", F.lit("second run").alias("run")))


STREAM_SCHEMA = "event_id bigint, ts timestamp, model string, item_id bigint, answer string"
STREAM_SQL = with_tables("ev_items") + """
, p AS (SELECT event_id, ts, event_type AS model, user_id AS item_id, substr('ABCD', CAST(event_id % 4 AS INT) + 1, 1) AS answer FROM events),
s AS (SELECT ts, model, CASE WHEN answer = gold THEN 1 ELSE 0 END AS r FROM p JOIN ev_items USING (item_id))
"""


def arriving(t, files_per_batch, delay):
    """Event rows as prediction files; every row arrives twice."""
    folder = scratch_path(t.spark, "arriving")
    rows = t.events.select(
        "event_id", "ts", F.col("event_type").alias("model"), F.col("user_id").alias("item_id"),
        F.substr(F.lit("ABCD"), (F.col("event_id") % 4).cast("int") + 1, F.lit(1)).alias("answer"),
    )
    rows.unionByName(rows).repartition(4).write.parquet(folder)
    stream = S.prediction_stream(t.spark, folder, STREAM_SCHEMA, files_per_batch)
    return S.scored_stream(stream, t.ev_items.select("item_id", "gold"), ["event_id"], "ts", delay)


@query("h17_running_accuracy", STREAM_SQL + "SELECT model, CAST(sum(r) AS BIGINT) AS \"right\", count(*) AS total FROM s GROUP BY model")
def _(t):
    path = scratch_path(t.spark, "counts")
    running = S.running_accuracy(arriving(t, 2, "60 days"), ["model"])
    S.run_batches(running, path, scratch_path(t.spark, "progress")).awaitTermination()
    return S.latest_counts(t.spark, path, ["model"])


@query("h17_windowed_accuracy", STREAM_SQL + """
, w AS (SELECT date_trunc('day', ts) AS d, model, CAST(sum(r) AS BIGINT) AS "right", count(*) AS total FROM s GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS start, model, "right", total FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def _(t):
    # one batch holds all rows, the batch after it closes the windows before the watermark
    path = scratch_path(t.spark, "windows")
    windowed = S.windowed_accuracy(arriving(t, None, "2 days"), ["model"], "ts", "1 day")
    S.run_available(windowed, path, scratch_path(t.spark, "progress")).awaitTermination()
    rows = t.spark.read.schema("start timestamp, model string, `right` bigint, total bigint").parquet(path)
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("h18_registered_functions", with_tables("ev_scored") + """
SELECT model, round(avg(CASE WHEN regexp_extract(prediction, '[A-D]+') = gold THEN 100e0 ELSE 0e0 END), 6) AS accuracy FROM ev_scored GROUP BY model""")
def _(t):
    rule, metric = registry.lookup("rule", "first_run"), registry.lookup("metric", "accuracy")
    rows = t.ev_scored.withColumn("answer", rule(F.col("prediction")))
    return round6(metric(rows, ["model"]))
