"""Micro tables and brute force for metrics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import classify as C
from evalmill.operators import exact as X
from evalmill.operators import instructions as I
from evalmill.operators import judge as J
from evalmill.operators import leaderboard as L
from evalmill.operators import likelihood as K
from evalmill.operators import overlap as O
from evalmill.operators import samples as S
from evalmill.operators import slices as Z


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(0)
    for _ in range(60):
        a = [rng.randrange(5) for _ in range(rng.randrange(0, 90))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 90))]
        assert O._lcs(a, b) == brute_lcs(a, b)


def test_rouge_l_and_code_line(spark):
    df = spark.createDataFrame([(1, "m", "the cat sat", ["the cat", "a dog sat down"]), (2, "m", "", ["x"])], "pair_id int, model string, prediction string, refs array<string>")
    assert one(O.rouge_l(df, ["model"]))["rougeL"] == pytest.approx(100 * (2 * 2 / 5 + 0) / 2)
    code = spark.createDataFrame([(1, "m", "\n# note\nx = 1\ny", ["x = 1", "z"])], "pair_id int, model string, prediction string, refs array<string>")
    assert one(O.code_similarity(code, ["model"]))["score"] == pytest.approx(100)


def test_cjk_words(spark):
    df = spark.createDataFrame([("中文 ab文",)], "t string")
    assert df.select(O.cjk_words(F.col("t"))).first()[0] == ["中", "文", "ab", "文"]


def test_token_f1_keeps_empty_rows_and_takes_the_best(spark):
    df = spark.createDataFrame(
        [(1, "m", "", ["a x", "b"]), (2, "m", "big red bus", ["bus", "red bus"]), (3, "m", "same", ["The same!"])],
        "pair_id int, model string, prediction string, refs array<string>",
    )
    got = one(X.token_f1(df, ["model"]))
    assert got["f1"] == pytest.approx(100 * (0 + 0.8 + 1) / 3) and got["em"] == pytest.approx(100 / 3)


def test_bleu_with_two_references(spark):
    pred = "the cat is on the mat today"
    refs = ["the cat sat on the mat", "there is a cat on the mat today"]
    df = spark.createDataFrame([(1, "m", pred, refs)], "pair_id int, model string, prediction string, refs array<string>")
    p, rs = pred.split(), [r.split() for r in refs]
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        best = Counter()
        for r in rs:
            best |= grams(r)
        hit, total = sum((grams(p) & best).values()), max(len(p) - n + 1, 0)
        if hit == 0:
            zeros += 1
        logs += math.log(100 * hit / total if hit else 100 / (2**zeros * total))
    closest = min((abs(len(r) - len(p)), len(r)) for r in rs)[1]
    expected = math.exp(logs / 4) * (math.exp(1 - closest / len(p)) if len(p) < closest else 1)
    assert one(O.corpus_bleu(df, ["model"]))["bleu"] == pytest.approx(expected)


def test_rouge_n_is_symmetric(spark):
    df = spark.createDataFrame([(1, "m", "a b c d", "a b x"), (2, "m", "", "y")], "pair_id int, model string, prediction string, reference string")
    swapped = df.select("pair_id", "model", F.col("reference").alias("prediction"), F.col("prediction").alias("reference"))
    a, b = one(O.rouge_n(df, ["model"])), one(O.rouge_n(swapped, ["model"]))
    assert a == b and a["rouge1"] == pytest.approx(100 * (4 / 7) / 2)


def test_auc_by_pairs(spark):
    rng = random.Random(3)
    rows = [("m", rng.randrange(8) / 8, rng.randrange(2)) for _ in range(300)]
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) * 100
    got = one(C.auc(spark.createDataFrame(rows, "model string, p1 double, label int"), ["model"]))
    assert got["auc_score"] == pytest.approx(expected)


def test_pass_at_k_edges(spark):
    df = spark.createDataFrame([("m", 1, 3, 1), ("m", 2, 3, 3)], "model string, item_id int, n bigint, c bigint")
    got = one(S.pass_at_k(df, ["model"], [1, 2, 3, 4]))
    assert got["pass@1"] == pytest.approx(100 * (1 / 3 + 1) / 2)
    assert got["pass@3"] == pytest.approx(100) and got["pass@4"] is None


def test_pass_at_one_is_the_share(spark):
    rng = random.Random(5)
    rows = [("m", i, n, rng.randint(0, n)) for i, n in enumerate(rng.randint(1, 9) for _ in range(50))]
    got = one(S.pass_at_k(spark.createDataFrame(rows, "model string, item_id int, n bigint, c bigint"), ["model"], [1]))
    assert got["pass@1"] == pytest.approx(100 * np.mean([c / n for _, _, n, c in rows]))


def test_g_pass_at_k(spark):
    from math import ceil, comb

    n, c, k = 10, 6, 4
    tail = lambda m: sum(comb(c, i) * comb(n - c, k - i) for i in range(m, k + 1)) / comb(n, k)
    got = one(S.g_pass_at_k(spark.createDataFrame([("m", 1, n, c)], "model string, item_id int, n bigint, c bigint"), ["model"], k))
    assert got["g_pass@4_0.75"] == pytest.approx(100 * tail(max(ceil(k * 0.75), 1)))
    assert got["mg_pass@4"] == pytest.approx(100 * 2 / k * sum(tail(i) for i in range(ceil(k / 2) + 1, k + 1)))


def test_majority_vote_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "B", 0), (1, "A", 1), (1, "A", 2), (1, "B", 3), (2, None, 0)], "item_id int, answer string, pos bigint")
    got = {r["item_id"]: r["vote"] for r in S.majority_vote(df, ["item_id"]).collect()}
    assert got == {1: "B", 2: None}


def test_equal_losses_take_the_first_label(spark):
    df = spark.createDataFrame([(1, "B", 1, 2.0), (1, "A", 0, 2.0), (1, "C", 2, 3.0)], "item_id int, label string, label_pos int, nll double")
    assert one(K.min_loss_choice(df))["choice"] == "A"
    got = one(K.choice_probabilities(df.withColumn("logp", -F.col("nll"))))
    assert got["pred_label"] == 0 and sum(got["prediction"]) == pytest.approx(1)


def test_bits_per_byte_single_label(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0, 8.0), (2, 2.0, 4.0, 8.0), (2, 4.0, 4.0, 8.0)], "item_id int, nll double, n_tokens double, n_bytes double")
    got = one(K.bits_per_byte(df))
    assert got["correct_bpb"] == pytest.approx(75) and got["incorrect_bpb"] == pytest.approx(200)


def test_sliding_windows_walk(spark):
    losses = [float(i) for i in range(23)]
    df = spark.createDataFrame([(i // 5, i % 5, x) for i, x in enumerate(losses)], "seq_id bigint, pos bigint, loss double")
    block, stride, expected, prev = 7, 3, {}, 0
    for i in range((len(losses) - block) // stride + 1):
        end = min(i * stride + block, len(losses))
        expected[i] = (end - prev, sum(losses[prev:end]))
        prev = end
    got = {r["window"]: (r["scored"], r["loss"]) for r in K.sliding_windows(df, block, stride).collect()}
    assert got == expected


def test_min_k_keeps_at_least_one(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, 5.0), (2, 0, 1.0)], "seq_id bigint, pos bigint, loss double")
    assert {r["seq_id"]: r["min_k"] for r in K.min_k_percent(df, 10).collect()} == {1: -5.0, 2: -1.0}


def test_group_scores_edges(spark):
    results = spark.createDataFrame([("m", "a", "acc", 4.0), ("m", "b", "acc", -1.0), ("m", "c", "acc", float("nan"))], "model string, dataset string, metric string, score double")
    rows = [("h", "a", "acc", 1.0, "harmonic_mean"), ("h", "b", "acc", 1.0, "harmonic_mean"), ("w", "a", "acc", 3.0, "weighted_average"),
            ("w", "c", "acc", 0.0, "weighted_average"), ("e", "a", "acc", 1.0, "sum"), ("e", "zz", "acc", 1.0, "sum"), ("none", "zz", "acc", 1.0, "sum")]
    got = {r["group"]: (r["metric"], r["score"]) for r in L.group_scores(results, spark.createDataFrame(rows, "`group` string, dataset string, metric string, weight double, how string")).collect()}
    assert got["h"] == ("harmonic_mean", pytest.approx(2 / (1 / 4 + 1)))
    assert got["w"] == ("weighted_average", pytest.approx(4.0))
    assert got["e"] == ("error", None) and "none" not in got


def test_longest_tolerable_rules(spark):
    rows = [("a", 2, 90.0), ("a", 3, 50.0), ("a", 4, 70.0), ("a", 5, 10.0), ("a", 6, 10.0), ("b", 2, 61.0), ("b", 9, 99.0), ("c", 2, None), ("c", 3, 80.0)]
    got = {r["model"]: r["max_needles"] for r in Z.longest_tolerable(spark.createDataFrame(rows, "model string, needle_count int, score double"), ["model"]).collect()}
    assert got == {"a": 4, "b": 9, "c": 0}


def test_toxicity_all_invalid(spark):
    df = spark.createDataFrame([("x", -1.0), ("y", 0.2), ("y", 0.9), ("y", -1.0)], "m string, toxicity_score double")
    got = {r["m"]: r for r in Z.toxicity_summary(df, ["m"]).collect()}
    assert got["x"]["valid_frac"] == 0 and got["x"]["avg_toxicity_score"] is None
    assert got["y"]["toxic_frac_valid"] == 0.5 and got["y"]["expected_max_toxicity"] == 0.9


def check(spark, name, text, **kwargs):
    df = spark.createDataFrame([(text,)], "x string")
    pairs = [F.lit(str(v)) for kv in kwargs.items() for v in kv] or [F.lit(""), F.lit("")]
    instruction = F.struct(F.lit(name).alias("id"), F.create_map(*pairs).alias("kwargs"))
    return df.select(I.followed(F.col("x"), instruction, [name])).first()[0]


@pytest.mark.parametrize(
    "name, good, bad, kwargs",
    [
        ("keywords:existence", "An Apple and pear", "apple", dict(keywords="apple|pear")),
        ("keywords:frequency", "cat cat", "cat", dict(keyword="cat", num=2, relation="at least")),
        ("keywords:forbidden_words", "catalog", "a Cat!", dict(keywords="cat|dog")),
        ("keywords:letter_frequency", "zz", "z", dict(letter="z", num=2, relation="at least")),
        ("length_constraints:number_sentences", "One. Two.", "One.", dict(num=2, relation="at least")),
        ("length_constraints:number_paragraphs", "a\n***\nb", "a", dict(num=2)),
        ("length_constraints:number_words", "a b c", "a b c d", dict(num=4, relation="less than")),
        ("length_constraints:nth_paragraph_first_word", "x y\n\nHello you", "x\n\nyou", dict(num=2, nth=2, first_word="hello")),
        ("detectable_content:number_placeholders", "[a] and [b]", "[a]", dict(num=2)),
        ("detectable_content:postscript", "bye\nP.S. hi", "bye", dict(marker="P.S.")),
        ("detectable_format:number_bullet_lists", "* a\n- b", "* a", dict(num=2)),
        ("detectable_format:constrained_response", "My answer is yes.", "maybe", dict(options="My answer is yes.|My answer is no.")),
        ("detectable_format:number_highlighted_sections", "*a* and **b**", "** **", dict(num=2)),
        ("detectable_format:multiple_sections", "SECTION 1\nx\nSECTION 2\ny", "SECTION 1", dict(marker="SECTION", num=2)),
        ("detectable_format:json_format", '```json\n{"a": 1}\n```', "not json", {}),
        ("detectable_format:title", "<<my title>>\ntext", "title", {}),
        ("combination:two_responses", "one\n******\ntwo", "one\n******\none", {}),
        ("combination:repeat_prompt", "Say hi. Hi!", "Hi!", dict(prompt="say hi.")),
        ("startend:end_checker", 'It is done."', "done it is", dict(phrase="done.")),
        ("change_case:english_capital", "ABC 1", "Abc", {}),
        ("change_case:english_lowercase", "abc 1", "Abc", {}),
        ("change_case:capital_word_frequency", "YES I can", "Yes", dict(num=2, relation="at least")),
        ("punctuation:no_comma", "a b", "a, b", {}),
        ("startend:quotation", '"quoted"', "quoted", {}),
    ],
)
def test_instruction_checks(spark, name, good, bad, kwargs):
    assert check(spark, name, good, **kwargs) is True
    assert check(spark, name, bad, **kwargs) is False
    assert check(spark, name, "  ", **kwargs) is False


def test_every_verifier_is_tested():
    marks = [m for m in test_instruction_checks.pytestmark if m.name == "parametrize"]
    assert {case[0] for case in marks[0].args[1]} == set(I.VERIFIERS)


def test_loose_variants_help(spark):
    df = spark.createDataFrame([("m", "Sure, here it is:\nno comma here")], "model string, response string").withColumn(
        "instructions", F.array(F.struct(F.lit("punctuation:no_comma").alias("id"), F.create_map(F.lit("a"), F.lit("b")).alias("kwargs")))
    )
    got = one(I.instruction_following(df, ["model"]))
    assert got["prompt_strict"] == 0 and got["prompt_loose"] == 100


def test_position_bias_both_orders(spark):
    rows = [("j", "q1", 1, "A"), ("j", "q1", 2, "A"), ("j", "q2", 1, "C"), ("j", "q2", 2, "C"), ("j", "q3", 1, "A"), ("j", "q3", 2, "B")]
    df = spark.createDataFrame(rows, "judge string, question string, o int, verdict string")
    assert one(J.position_bias(df, ["judge"], ["question"], "o"))["position_bias"] == 1


def test_bootstrap_std_is_close_to_theory(spark):
    rng = np.random.default_rng(0)
    values = rng.random(3000)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(values)], "model string, item_id bigint, score double")
    got = one(J.bootstrap_std(df, ["model"], "item_id", "score", rounds=400))["bootstrap_std"]
    assert got == pytest.approx(values.std() / math.sqrt(len(values)), rel=0.15)
    again = one(J.bootstrap_std(df.repartition(5), ["model"], "item_id", "score", rounds=400))["bootstrap_std"]
    assert got == pytest.approx(again, rel=1e-9)


def test_rubric_without_positive_points(spark):
    df = spark.createDataFrame([("m", 1, -2.0, True), ("m", 2, 4.0, True), ("m", 2, 4.0, False)], "model string, item_id int, points double, criteria_met boolean")
    assert {r["item_id"]: r["score"] for r in J.rubric_scores(df, ["model"]).collect()} == {1: None, 2: 0.5}


def test_tidy_skips_errors_and_text(spark):
    df = spark.createDataFrame([("m", "a", {"note": "x", "f1": "2.0", "accuracy": "1.5", "bp": "1"}), ("m", "b", {"error": "e", "accuracy": "1"})], "model string, dataset string, metrics map<string,string>")
    got = [(r["metric"], r["score"], r["metric_rank"]) for r in L.tidy(df).orderBy("metric_rank").collect()]
    assert got == [("accuracy", 1.5, 1), ("f1", 2.0, 2)]


def test_math_strings(spark):
    df = spark.createDataFrame([("m", r"x=\left( \tfrac12 \right)", r"(\frac{1}{2})"), ("m", "1/2", "0.5"), ("m", ".5\\%", "0.5")], "model string, prediction string, reference string")
    assert [r[0] for r in df.select(X.math_string(F.col("prediction")) == X.math_string(F.col("reference"))).collect()][:2] == [True, True]


def test_groups_of_groups(spark):
    from evalmill.plans.leaderboard_plans import NESTED_SCHEMA

    assert L.group_levels([("a", "x"), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "y")]) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="contain each other"):
        L.group_levels([("a", "b"), ("b", "a"), ("c", "x")])
    results = spark.createDataFrame(
        [("m", "x", "f1", 2.0, 1), ("m", "x", "em", 4.0, 2), ("m", "y", "em", 8.0, 1), ("k", "x", "f1", 1.0, 1), ("m", "z", "zero", 0.0, 1)],
        "model string, dataset string, metric string, score double, metric_rank int",
    )
    rows = [
        ("g", "x", None, None, "naive_average", None), ("g", "y", None, None, "naive_average", None),
        ("h", "g", None, 3.0, "weighted_average", "naive_average"), ("h", "z", None, None, "weighted_average", "naive_average"),
        ("i", "g", None, None, "harmonic_mean", "all"), ("i", "z", None, None, "harmonic_mean", "all"),
    ]
    got = {(r["model"], r["group"], r["metric"]): (r["score"], r["metric_rank"]) for r in L.nested_groups(results, spark.createDataFrame(rows, NESTED_SCHEMA)).collect()}
    # g: em is common, the default takes f1 of x and em of y; z has no weight in h; k lacks y, and so all above
    assert got == {
        ("m", "g", "em"): (6.0, 1), ("m", "g", "naive_average"): (5.0, 2), ("k", "g", "error"): (None, 1),
        ("m", "h", "naive_average"): (6.0, 1), ("m", "i", "all"): (2 / (1 / 6.0 + 1 / 1.0), 1),
    }
    with pytest.raises(ValueError, match="with and without"):
        L.nested_groups(results, spark.createDataFrame([*rows, ("g", "x", "f1", None, "naive_average", None)], NESTED_SCHEMA))


def test_second_math_clean_up(spark):
    pairs = {
        " $\\dfrac{1}{2}$.": "\\frac{1}{2}", "\\text{Friday}": "{Friday}", "12\\text{ cm}": "12", "k=3.0": "3", "0.5": "0.5", ".5": "0.5", "-inf": "-\\infty",
        "(-\\infty, infinity)": "(-\\infty,\\infty)", "2j": "2i", "ij": "ij", "3 and 4": "34", "\\mathbf{v}": "{v}", "5\\mbox{ m}": "5", "\\sqrt12": "\\sqrt{12}",
        "1.0x": "1x", "7/8": "\\frac{7}{8}", "a=b=c": "a=b=c", "2 \\cdot 3": "23", "": "",
    }
    rows = spark.createDataFrame(list(pairs.items()), "said string, want string").withColumn("got", X.math_string_v2(F.col("said"))).collect()
    assert {r["said"]: r["got"] for r in rows} == pairs
