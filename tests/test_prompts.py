import pytest
from pyspark.sql import functions as F

from evalmill.operators import prompts as P


def test_render_does_not_refill(spark):
    df = spark.createDataFrame([("{b}", "x", None)], "a string, b string, c string")
    got = df.select(P.render("{a}-{b}-{c}-{d}", P.columns_of(df))).first()[0]
    assert got == "{b}-x-None-{d}"


@pytest.mark.parametrize("spec", ["[2:9]", "[:5]", "[-4:]", "[::3]", "[1:-2:2]", "[::-2]", "[8:2:-3]", "[30:]"])
def test_take_range_is_python_slicing(spark, spec):
    df = spark.range(20).withColumnRenamed("id", "idx")
    part = slice(*[int(x) if x else None for x in (spec[1:-1].split(":") + [""])[:3]])
    got = sorted(r["idx"] for r in P.take_range(df, spec).collect())
    assert got == sorted(list(range(20))[part])


def test_take_range_refuses_code(spark):
    with pytest.raises(ValueError):
        P.take_range(spark.range(3), "[__import__('os')]")


def test_sample_exact_sizes(spark):
    df = spark.range(1000)
    assert P.sample_exact(df, 0.25, "id").count() == 250
    assert P.sample_exact(df, 40, "id").count() == 40
    assert P.sample_exact(df, -1, "id").count() == 1000
    assert P.sample_exact(df, 5000, "id").count() == 1000
    a = {r["id"] for r in P.sample_exact(df, 100, "id", 3).collect()}
    assert a == {r["id"] for r in P.sample_exact(df.repartition(7), 100, "id", 3).collect()}
    assert a != {r["id"] for r in P.sample_exact(df, 100, "id", 4).collect()}


def test_replicate_needs_enough_copies(spark):
    with pytest.raises(ValueError):
        P.replicate(spark.range(2), 2, ks=[4])


def test_rotations_keep_the_gold_text(spark):
    df = spark.createDataFrame([(1, ["w", "x", "y", "z"], "C"), (2, ["p", "q", "r", "s"], "none")], "id int, options array<string>, gold string")
    for mode, n in (("circular", 4), ("all", 24)):
        rows = P.rotate_options(df, mode).collect()
        assert len(rows) == 2 * n
        for r in rows:
            if r["id"] == 1:
                assert r["options"]["ABCD".index(r["gold"])] == "y"
            else:
                assert r["gold"] == "none"


def test_shuffle_options_keeps_gold_text_and_varies(spark):
    df = spark.range(200).select("id", F.array(*[F.lit(c) for c in "wxyz"]).alias("options"), F.lit("B").alias("gold"))
    rows = P.shuffle_options(df, 1, "id").collect()
    assert all(r["options"]["ABCD".index(r["gold"])] == "x" for r in rows)
    assert len({r["circular_pattern"] for r in rows}) == 24


def test_balance_positions_swaps_half(spark):
    df = spark.range(101).select(F.col("id").alias("item_id"), F.lit("x").alias("model_a"), F.lit("y").alias("model_b"))
    assert P.balance_positions(df, 2, "item_id").filter("swapped").count() == 50
    assert P.balance_positions(df, 3, "item_id").filter("model_a = 'y'").count() == 51


def test_split_serves_as_both(spark):
    df = spark.createDataFrame([(1, "val")], "id int, split string")
    assert {r["split"] for r in P.split_normalise(df, "val", "val").collect()} == {"train", "test"}
    assert P.split_normalise(df.drop("split"), None, None).count() == 2


def test_fit_context_keeps_a_prefix(spark):
    edges = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 1), (2, 1, 3)], "test_id int, rank int, n_tokens int")
    bare = spark.createDataFrame([(1, 3), (2, 100)], "test_id int, base_tokens int")
    got = [(r["test_id"], r["rank"]) for r in P.fit_context(edges, 9, bare).collect()]
    assert got == [(1, 1)]


def test_labels_from_output_refuses_free_text(spark):
    with pytest.raises(ValueError):
        P.labels_from_output(spark.range(50), "id", limit=10)


TURNS = [
    (0, None, "begin", None),
    (1, "SYSTEM", "system msg", None),
    (2, "HUMAN", "U0", None),
    (3, "BOT", "B0", None),
    (4, "HUMAN", "U1", "\n"),
    (5, "BOT", "B1", None),
    (6, "HUMAN", "U2", None),
    (7, "BOT", "B2", None),
    (8, None, "end", None),
]


def rounds(spark, thinks: bool, system: bool, generate: bool, turns=TURNS) -> str:
    conv = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn int, role string, text string, turn_end string")
    roles = [
        P.RoleMarks("HUMAN", "<H>:", "<eoh>\n"),
        P.RoleMarks("THOUGHTS", "<T>:", "<eot>\n", "None", generate=thinks),
        P.RoleMarks("BOT", "<B>:", "<eob>\n", generate=not thinks),
    ]
    reserved = [P.RoleMarks("SYSTEM", "<S>:", "<eos>\n")] if system else []
    return P.render_rounds(conv, roles, reserved, {"SYSTEM": "HUMAN"}, "meta\n", "meta end", generate).first()["prompt"]


@pytest.mark.parametrize("system", [False, True])
def test_render_rounds(spark, system):
    first = "<S>:system msg<eos>\n" if system else "<H>:system msg<eoh>\n"
    common = "meta\nbegin" + first + "<H>:U0<eoh>\n<T>:None<eot>\n<B>:B0<eob>\n<H>:U1\n<T>:None<eot>\n<B>:B1<eob>\n<H>:U2<eoh>\n<T>:"
    whole = common + "None<eot>\n<B>:B2<eob>\nendmeta end"
    assert rounds(spark, True, system, generate=True) == common
    assert rounds(spark, False, system, generate=True) == common + "None<eot>\n<B>:"
    assert rounds(spark, True, system, generate=False) == rounds(spark, False, system, generate=False) == whole


def test_render_rounds_edges(spark):
    alone = [(0, "SYSTEM", "s", None)]
    assert rounds(spark, True, True, True, alone) == "meta\n<S>:s<eos>\nmeta end"
    two = [(0, "BOT", "b", None), (1, "BOT", None, None)]
    filled = "<H>:<eoh>\n<T>:None<eot>\n"
    assert rounds(spark, False, True, False, two) == f"meta\n{filled}<B>:b<eob>\n{filled}<B>:<eob>\nmeta end"
    assert rounds(spark, False, True, True, two) == f"meta\n{filled}<B>:b<eob>\n{filled}<B>:"
    with pytest.raises(Exception, match="no marks for role"):
        rounds(spark, True, True, False, [(0, "JUDGE", "x", None)])
