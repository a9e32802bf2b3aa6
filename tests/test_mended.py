"""Cases that once gave other answers than the rules they follow."""

import pytest
from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.operators import exact as X
from evalmill.operators import instructions as I
from evalmill.operators import likelihood as K
from evalmill.operators import overlap as O
from evalmill.operators import samples as S
from evalmill.operators.model import resume
from evalmill.sources import readers, writers


def value(spark, rule, text):
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t"))).first()[0]


def test_bleu_counts_every_reference(spark):
    same = "a b c d e f"
    df = spark.createDataFrame([("m", 1, same, ["x y z", same])], "model string, pair_id int, prediction string, refs array<string>")
    assert O.corpus_bleu(df, ["model"]).first()["bleu"] == pytest.approx(100)


def test_short_items_score_zero(spark):
    counts = spark.createDataFrame([("m", 1, 8, 0), ("m", 2, 2, 2), ("m", 3, 8, 8)], "model string, item_id int, n bigint, c bigint")
    assert S.g_pass_at_k(counts, ["model"], 4).first()["g_pass@4_1.0"] == pytest.approx(100 / 3)


def test_verdict_styles(spark):
    assert value(spark, E.verdict("letter"), "I like some text") is None and value(spark, E.verdict("letter"), "M is it") == "M"
    assert value(spark, E.verdict("json_score"), '{"score": "7.5"}') == "7.5"
    assert value(spark, E.verdict("winner"), '{"winner": "A"} then {"winner": "C"}') == "C" and value(spark, E.verdict("winner"), '"胜者": "B"') == "B"


def test_checklists_and_entities(spark):
    listed = '[{"checklist_id": 0, "evaluation_score": "0.5"}]'
    assert value(spark, E.checklist_scores(1), listed) == [0.5] and value(spark, E.checklist_scores(1), "so: " + listed) is None
    said = E.predicted_entities(["place"])
    assert value(spark, said, "place: Paris today") == {"place": "Paris"}
    assert value(spark, said, "place: Rome x\nplace：Oslo\n") == {"place": "Oslo"} and value(spark, said, "place:无 .") == {}


def test_numbers_and_math(spark):
    df = spark.createDataFrame([("m", "007 8", "7 8")], "model string, prediction string, reference string")
    assert X.prefix_match(df, ["model"]).first()["score"] == 200
    assert value(spark, X.math_string, "k = 3") == "3" and value(spark, X.math_string, "50%") == "50%" and value(spark, X.math_string, r"50\%") == "50"


def test_nan_losses_are_left_out(spark):
    rows = [(1, "a", 1.0), (1, "b", 3.0), (1, "c", float("nan")), (2, "a", 2.0), (2, "b", 4.0)]
    df = spark.createDataFrame(rows, "item_id int, label string, nll double").withColumns({"n_tokens": F.lit(1.0), "n_bytes": F.lit(1.0)})
    assert tuple(K.bits_per_byte(df).first()) == (150.0, 350.0)


def test_first_word_is_whole(spark):
    words = [value(spark, I.first_word, t) for t in ("Thermal power", '"The, end', "the")]
    assert words == ["thermal", "the", "the"]


def test_readers_go_by_name_and_raise(spark, tmp_path):
    (tmp_path / "x.csv").write_text('b,a\n1,"two\nlines"\n')
    assert tuple(readers.read_items(spark, str(tmp_path / "x.csv"), "csv", "a string, b int").first()) == ("two\nlines", 1)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_items(spark, str(tmp_path / "x.jsonl"), "jsonl", "a int").collect()
    (tmp_path / "law_test.csv").write_text('"a ""question""\non two lines",1,2,3,4,A\n')
    assert readers.read_subject_files(spark, str(tmp_path), "test").first()["input"] == 'a "question"\non two lines'


def test_text_board_keeps_long_names(spark, tmp_path):
    name = "a_very_long_dataset_name_over_24_chars"
    writers.write_leaderboard(spark.createDataFrame([(name, 1.5)], "dataset string, m0 double"), str(tmp_path / "b"), "text")
    assert [r[0] for r in spark.read.text(str(tmp_path / "b")).collect()] == ["dataset".ljust(len(name)) + " m0", name + " 1.5"]


def test_resume_does_not_hide_errors(spark, tmp_path):
    tasks = spark.range(3)
    path = str(tmp_path / "out")
    assert resume(tasks, path, ["id"], lambda d: d).count() == 3 and resume(tasks, path, ["id"], lambda d: d).count() == 3
    with pytest.raises(Exception):
        resume(tasks, path, ["other"], lambda d: d)


def test_ngrams_and_bags_stay_in_their_row(spark):
    """Tokens were exploded and grouped; rows of one key still count as one bag."""
    rows = [("m", 1, "a b a b", ["a b", "b a b"]), ("m", 1, "a b", ["a b a", None]), ("m", 2, None, ["x"]), ("m", None, "", None), ("n", 2, "q", ["q q"])]
    df = spark.createDataFrame(rows, "model string, k int, p string, refs array<string>")
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    counts = O.ngram_overlap(df, ["model", "k"], split(F.col("p")), F.transform("refs", split), (1, 2))
    got = {(r["model"], r["k"], r["n"]): (r["matched"], r["n_pred"], r["n_ref"]) for r in counts.collect()}
    assert got == {("m", 1, 1): (5, 6, 5), ("m", 1, 2): (3, 4, 3), ("m", None, 1): (0, 0, 0), ("m", None, 2): (0, 0, 0), ("n", 2, 1): (1, 1, 2), ("n", 2, 2): (0, 0, 1)}
    bags = O.bag_overlap(df, ["model", "k"], split(F.col("p")), split(F.coalesce(F.get("refs", F.lit(0)), F.lit(""))))
    assert {(r["model"], r["k"]): (r["both"], r["n_a"], r["n_b"]) for r in bags.collect()} == {("m", 1): (5, 6, 5), ("m", None): (0, 0, 0), ("n", 2): (1, 1, 2)}
    assert not any("Generate" in d._jdf.queryExecution().optimizedPlan().toString() for d in (counts, bags))
