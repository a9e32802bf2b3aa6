import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalmill.operators import model as M
from evalmill.operators import sequences as Q
from evalmill.operators import synthetic as Y


def test_mask_share_follows_its_ratio(spark):
    df = spark.range(300).select(F.col("id").alias("seq_id"), F.sequence(F.lit(1), F.lit(200)).alias("input_ids"))
    rows = Q.mask_tokens(df, eps=0.01, seed=1).collect()
    ratios = np.array([r["p_mask"] for r in rows])
    shares = np.array([np.mean(r["masked"]) for r in rows])
    assert ratios.min() >= 0.01 and abs(ratios.mean() - 0.505) < 0.05
    assert abs(shares - ratios).max() < 0.17 and abs((shares - ratios).mean()) < 0.01
    for r in rows[:20]:
        assert all((n == Q.MASK_ID) if m else (n == x) for n, m, x in zip(r["noisy"], r["masked"], r["input_ids"]))


def test_sft_never_masks_the_prompt(spark):
    df = spark.createDataFrame([(i, [1, 2, 3], [7, 8]) for i in range(100)], "seq_id bigint, prompt_ids array<int>, answer_ids array<int>")
    rows = Q.sft_rows(df, 8, eos_id=0).collect()
    assert all(r["input_ids"] == [1, 2, 3, 7, 8, 0, 0, 0] and r["answer_length"] == 5 for r in rows)
    assert not any(any(r["masked"][:3]) for r in rows) and any(any(r["masked"][3:]) for r in rows)
    for r in rows:
        assert r["weight"] == pytest.approx([1 / (r["p_mask"] * 5) if m else 0 for m in r["masked"]])


def test_truncate_share(spark):
    df = spark.range(5000).select(F.col("id").alias("seq_id"), F.sequence(F.lit(1), F.lit(50)).alias("input_ids"))
    sizes = [len(r["input_ids"]) for r in Q.truncate_random(df, 0.1, 3).collect()]
    cut = [s for s in sizes if s < 50]
    assert 380 < len(cut) < 600 and min(cut) >= 1


def test_stratified_mask_counts(spark):
    df = spark.createDataFrame([(i, 4, 10) for i in range(30)], "item_id bigint, prompt_length int, target_length int")
    rows = Q.stratified_masks(df, 5).collect()
    per = {}
    for r in rows:
        assert len(r["positions"]) == r["masked"] and r["ratio"] == pytest.approx(r["masked"] / 10)
        assert set(r["positions"]) <= set(range(4, 14)) and len(set(r["positions"])) == r["masked"]
        per.setdefault(r["item_id"], {})[r["batch"]] = r["masked"]
    for counts in per.values():
        k = counts[0]
        assert [counts[b] for b in range(5)] == [(k + 2 * b - 1) % 10 + 1 for b in range(5)]


def test_schedule_sums_to_the_masked_count(spark):
    df = spark.createDataFrame([(i, i) for i in range(40)], "seq_id bigint, masked bigint")
    sums = Q.unmask_schedule(df, 7).groupBy("seq_id", "masked").agg(F.sum("reveal").alias("s"), F.max("reveal").alias("hi"), F.min("reveal").alias("lo"))
    assert all(r["s"] == r["masked"] and r["hi"] - r["lo"] <= 1 for r in sums.collect())


def test_probes_of_short_texts(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, [str(i) for i in range(30)])], "doc_id int, tokens array<string>")
    rows = Q.continuation_probes(df, 5, 5).orderBy("doc_id", "probe").collect()
    assert [r["cut"] for r in rows if r["doc_id"] == 2] == list(np.linspace(2, 25, 5, dtype=int))
    assert all(r["cut"] == 2 and r["reference"] == "" for r in rows if r["doc_id"] == 1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(40).select(
        F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat_ws("_", F.lit("d"), F.col("id"), i)).alias("tokens")
    )


def test_needle_sits_at_its_depth(spark, docs):
    needles = spark.createDataFrame([(0, ["THE", "NEEDLE"], "where?", "NEEDLE"), (1, ["THE", "NEEDLE"], "where?", "NEEDLE")], "repeat int, needle array<string>, question string, keyword string")
    rows = Y.needle_haystack(docs, needles, [50, 100], [0, 50, 100], 2).collect()
    assert len(rows) == 12
    for r in rows:
        words = r["prompt"].split("\n\n")[0].split(" ")
        assert len(words) == r["length"] and words.index("THE") == int((r["length"] - 2) * r["depth"] / 100)
        assert r["answer"] == "THE NEEDLE*NEEDLE"
    a, b = ([r["prompt"] for r in rows if r["repeat"] == i and r["depth"] == 0 and r["length"] == 100][0] for i in (0, 1))
    assert a != b


def test_multi_and_parallel_places(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(100)], [["x", "x"], ["y"], ["z"]], ["x", "y", "z"])], "i int, haystack array<string>, needles array<array<string>>, keywords array<string>")
    words = Y.multi_needle(df, 20, 10).first()["context"].split(" ")
    assert words.index("x") == 20 and words.index("y") == 32 and words.index("z") == 43 and len(words) == 104
    r = Y.parallel_needles(df, [10, 50, 100]).first()
    words = r["context"].split(" ")
    assert words[words.index("x") - 1] == "9" and words[words.index("y") - 1] == "49" and words[-1] == "z"
    assert r["answer"] == "x*y*z#10*50*100"


def test_kinship_chain_leads_to_the_answer(spark):
    names = [f"N{i}x" for i in range(12)]
    for r in Y.kinship_chains(spark.range(20).withColumnRenamed("id", "item_id"), names, 5).collect():
        chain = r["chain"]
        assert len(set(chain)) == 5 and r["answer"] == chain[0] and f"'{chain[-1]}'" in r["prompt"]
        for a, b in zip(chain, chain[1:]):
            assert any(a in s and b in s for s in r["prompt"].split(". "))


def test_key_values_can_be_found(spark):
    items = spark.range(10).select(F.col("id").alias("item_id"), F.array(F.lit("noise one"), F.lit("noise two")).alias("lines"))
    for decoys in (False, True):
        for r in Y.key_value_needles(items, F.col("lines"), 30, keys=4, values=2, queries=2, decoys=decoys).collect():
            lines = r["prompt"].split("\n")
            assert len(lines) == 30 + 8 + 1 and len(r["answers"]) == 4
            for value in r["answers"]:
                line = next(x for x in lines if x.endswith(f"is: {value}."))
                assert line.split(" for ")[1].split(" is:")[0] in lines[-1]


def test_variables_stay_in_order(spark):
    for r in Y.variable_chains(spark.range(10).withColumnRenamed("id", "item_id"), "noise.", 25, chains=2, hops=3).collect():
        names = r["answers"]
        at = [r["prompt"].index(f"VAR {n} =") for n in names]
        assert len(set(names)) == 4 and at == sorted(at) and f"VAR {names[2]} = VAR {names[1]}" in r["prompt"]


def test_word_counts(spark, docs):
    vocabulary = Y.word_vocabulary(docs)
    assert vocabulary.count() == 400 and vocabulary.agg(F.max("idx")).first()[0] == 399
    items = spark.range(5).withColumnRenamed("id", "item_id")
    for r in Y.common_words(items, vocabulary, 20, 4, 6, 2).collect():
        listed = r["prompt"].split("\n")[0].split(" ")[1::2]
        counts = {w: listed.count(w) for w in set(listed)}
        assert len(counts) == 20 and {w for w, c in counts.items() if c == 6} == set(r["answers"]) and sorted(counts.values())[0] == 2
    for r in Y.frequent_words(items, vocabulary, 30, 400).collect():
        words = r["prompt"].split(" ")
        ranked = sorted(set(words), key=lambda w: -words.count(w))
        assert ranked[0] == "..." and set(ranked[1:4]) == set(r["answers"])


def test_distractors_keep_gold_and_budget(spark, docs):
    table = docs.select("doc_id", F.array_join("tokens", " ").alias("text"), F.lit(10).alias("n_tokens"))
    questions = spark.createDataFrame([(1, "q?", "a", [3, 5]), (2, "q?", "b", [7])], "item_id bigint, question string, answer string, gold array<bigint>")
    for r in Y.distractor_qa(questions, table, 80, pool=20).collect():
        gold = {"a": {3, 5}, "b": {7}}[r["answer"]]
        assert gold <= set(r["doc_ids"]) and len(r["doc_ids"]) == len(set(r["doc_ids"])) == 8
    tight = Y.distractor_qa(questions, table, 5, pool=20).collect()
    assert {r["answer"]: set(r["doc_ids"]) for r in tight} == {"a": {3, 5}, "b": {7}}


def test_model_errors_stay_with_their_rows(spark):
    def load_half():
        def run(batch):
            if (batch["id"] % 7 == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"y": batch["id"] / 2})

        return run

    rows = M.score_with_model(spark.range(50), load_half, "y double", batch=10, samples=2).collect()
    assert len(rows) == 100
    for r in rows:
        assert (r["error"], r["y"]) == (("three", None) if r["id"] % 7 == 3 else (None, r["id"] / 2))


def test_resume_does_only_the_rest(spark, tmp_path):
    path, asked = str(tmp_path / "out"), []

    def work(df):
        asked.append(df.count())
        return df

    M.resume(spark.range(10), path, ["id"], work)
    M.resume(spark.range(15), path, ["id"], work)
    assert M.resume(spark.range(15), path, ["id"], work).count() == 15
    assert asked == [10, 5, 0]


@pytest.mark.parametrize("budget, pool", [(0, 4), (60, 1), (60, 16), (10**6, 3)])
def test_distractors_fill_the_budget(spark, budget, pool):
    sizes = {i: (i * 7) % 13 for i in range(50)}
    docs = spark.createDataFrame([(i, f"text {i}", n) for i, n in sizes.items()], "doc_id bigint, text string, n_tokens int")
    questions = spark.createDataFrame([(q, "why?", "so", [q, q + 1]) for q in range(12)], "item_id bigint, question string, answer string, gold array<bigint>")
    rows = Y.distractor_qa(questions, docs, budget, pool=pool, seed=5).collect()
    assert len(rows) == 12
    for r in rows:
        ids = r["doc_ids"]
        used = sum(sizes[i] for i in ids)
        assert len(set(ids)) == len(ids) and {r["item_id"], r["item_id"] + 1} <= set(ids) and r["prompt"].count("Document ") == len(ids)
        if budget == 10**6:
            assert set(ids) == set(sizes)
        elif budget:
            assert budget - max(sizes.values()) < used <= budget
        else:
            assert len(ids) == 2 and len(rows) == 12
    assert rows != Y.distractor_qa(questions, docs, budget, pool=pool, seed=6).collect() or not budget
