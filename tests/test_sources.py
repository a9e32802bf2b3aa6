import datetime as dt
import json

import pytest

from evalmill import registry
from evalmill.operators import align as A
from evalmill.operators import leaderboard as L
from evalmill.sources import readers as R
from evalmill.sources import writers as W
from evalmill.streaming import scoring as S


def test_items_with_a_byte_order_mark(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text("﻿" + '{"q": "x", "n": 1}\n\n{"q": "é"}\n', encoding="utf-8")
    got = [(r["q"], r["n"]) for r in R.read_items(spark, str(lines), "jsonl", "q string, n int").collect()]
    assert got == [("x", 1), ("é", None)]
    table = tmp_path / "a.csv"
    table.write_text("﻿" + 'q,n\n"a, ""b""",2\n', encoding="utf-8")
    assert [tuple(r) for r in R.read_items(spark, str(table), "csv", "q string, n int").collect()] == [('a, "b"', 2)]
    with pytest.raises(ValueError):
        R.read_items(spark, str(table), "xml", "q string")


def test_subject_files(spark, tmp_path):
    (tmp_path / "art_test.csv").write_text('"a,b",1,2,3,4,A\n')
    (tmp_path / "world_history_test.csv").write_text("q,1,2,3,4,B\n")
    (tmp_path / "art_dev.csv").write_text("dev,1,2,3,4,C\n")
    got = {(r["subject"], r["input"], r["target"]) for r in R.read_subject_files(spark, str(tmp_path), "test").collect()}
    assert got == {("art", "a,b", "A"), ("world_history", "q", "B")}
    (tmp_path / "bad_test.csv").write_text("too,few\n")
    with pytest.raises(Exception):
        R.read_subject_files(spark, str(tmp_path), "test").collect()


def test_nested_qa(spark, tmp_path):
    doc = {"data": [{"paragraphs": [{"context": "c", "qas": [
        {"id": "1", "question": "q1", "is_impossible": False, "answers": [{"text": "x"}, {"text": "x"}, {"text": "y"}]},
        {"id": "2", "question": "q2", "is_impossible": True, "answers": [], "plausible_answers": [{"text": "p"}]},
        {"id": "3", "question": "q3", "is_impossible": True, "answers": []}]}]}]}
    path = tmp_path / "n.json"
    path.write_text(json.dumps(doc, indent=1))
    got = {r["id"]: r["answers"] for r in R.read_nested_qa(spark, str(path)).collect()}
    assert got == {"1": ["x", "y"], "2": ["p", "impossible to answer"], "3": ["impossible to answer"]}


def test_shards_stop_at_the_first_gap(spark, tmp_path):
    for shard, n in ((0, 3), (1, 2), (3, 4), (10, 1)):
        rows = {str(i): {"origin_prompt": f"p{shard}-{i}", "prediction": "x", "gold": "y"} for i in range(n)}
        (tmp_path / f"preds_{shard}.json").write_text(json.dumps(rows))
    got = sorted((r["position"], r["origin_prompt"]) for r in R.read_prediction_shards(spark, str(tmp_path / "preds_*.json")).collect())
    assert got == [(0, "p0-0"), (1, "p0-1"), (2, "p0-2"), (3, "p1-0"), (4, "p1-1")]


def test_missing_and_extra_ids(spark):
    preds = spark.createDataFrame([("m", 1), ("m", 9), ("n", 1), ("n", 2)], "model string, item_id int")
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    got = {r["model"]: (r["missing"], r["extra"], r["complete"]) for r in A.check_complete(preds, items).collect()}
    assert got == {"m": (1, 1, False), "n": (0, 0, True)}


def test_leaderboard_formats(spark, tmp_path):
    results = spark.createDataFrame([("m", "a,b", "acc", 1.005), ("n", "c", "acc", 2.0)], "model string, dataset string, metric string, score double")
    board = L.pivot_models(results, ["m", "n"])
    for fmt in ("csv", "markdown", "text"):
        W.write_leaderboard(board, str(tmp_path / fmt), fmt)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert lines[:2] == ["| dataset | metric | m | n |", "|---|---|---|---|"] and "| c | acc | - | 2.00 |" in lines
    assert {r["dataset"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"a b", "c"}


def test_store_skips_and_overwrites(spark, tmp_path):
    store = W.ResultStore(spark, str(tmp_path / "store"))
    row = lambda s: spark.createDataFrame([("m", "d", "acc", s), ("n", "d", "acc", s)], "model string, dataset string, metric string, score double")
    store.publish(row(1.0).filter("model = 'm'"))
    store.publish(row(2.0))
    assert {r["model"]: r["score"] for r in store.lookup().collect()} == {"m": 1.0, "n": 2.0}
    store.publish(row(3.0).filter("model = 'm'"), overwrite=True)
    assert {r["model"]: r["score"] for r in store.lookup().collect()} == {"m": 3.0, "n": 2.0}


def test_stream_counts_grow_and_repeats_do_not_count(spark, tmp_path):
    items = spark.createDataFrame([(1, "A"), (2, "B")], "item_id bigint, gold string")
    schema = "event_id bigint, ts timestamp, model string, item_id bigint, answer string"
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    noon = dt.datetime(2024, 1, 1, 12)

    def arrive(*rows):
        spark.createDataFrame([(i, noon, m, q, a) for i, m, q, a in rows], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = S.prediction_stream(spark, folder, schema)
        counts = S.running_accuracy(S.scored_stream(stream, items, ["event_id"], "ts", "1 day"), ["model"])
        S.run_batches(counts, out, progress).awaitTermination()
        return {r["model"]: (r["right"], r["total"]) for r in S.latest_counts(spark, out, ["model"]).collect()}

    arrive((1, "m", 1, "A"), (2, "m", 2, "A"), (2, "m", 2, "A"))
    assert run() == {"m": (1, 2)}
    arrive((2, "m", 2, "A"), (3, "m", 2, "B"), (4, "n", 1, "A"))
    assert run() == {"m": (2, 3), "n": (1, 1)}


def test_registry():
    registry.register("rule", "test only", lambda c: c)
    assert "test only" in registry.names("rule")
    with pytest.raises(ValueError):
        registry.register("rule", "test only", lambda c: c)
    with pytest.raises(KeyError):
        registry.lookup("rule", "nothing")


def test_pinned_tables_lie_in_the_shared_folder(spark):
    from evalmill.session import pin, shared_dir

    df = pin(spark.range(5))
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]
