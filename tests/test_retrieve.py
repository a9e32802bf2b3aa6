import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import retrieve as R

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(120, DIM))
    data[50] = data[51]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "train_id bigint, vec array<double>")


def edges(df):
    out = {}
    for r in df.orderBy("test_id", "rank").collect():
        out.setdefault(r["test_id"], []).append(r["train_id"])
    return out


@pytest.mark.parametrize("blocks", [{}, {"direct": 0, "test_block": 32, "train_block": 40}])
def test_dense_is_exact_and_ties_take_the_larger_id(vectors, blocks):
    data, train = vectors
    test = train.withColumnRenamed("train_id", "test_id")
    got = edges(R.retrieve_dense(test, train, 5, **blocks))
    scores = np.round(data @ data.T, 9)
    for i in range(len(data)):
        assert got[i] == sorted(range(len(data)), key=lambda j: (-scores[i, j], -j))[:5]


@pytest.mark.parametrize("blocks", [{}, {"direct": 0, "test_block": 2, "train_block": 2}])
def test_bm25_by_hand(spark, blocks):
    texts = ["the cat sat", "the dog sat down", "a cat and a cat", "the", "", "unrelated words"]
    train = spark.createDataFrame(list(enumerate(texts)), "train_id bigint, text string")
    test = spark.createDataFrame([(0, "cat the the"), (1, "zebra"), (2, "Sat")], "test_id bigint, text string")
    docs = [t.split() for t in texts]
    n, avg = len(docs), np.mean([len(d) for d in docs])
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    got = {}
    for r in R.retrieve_bm25(test, train, 6, **blocks).collect():
        got.setdefault(r["test_id"], {})[r["rank"]] = (r["train_id"], r["score"])
    for q, text in [(0, "cat the the"), (1, "zebra"), (2, "sat")]:
        score = []
        for i, d in enumerate(docs):
            s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in text.split())
            score.append((round(s, 9), i))
        expected = sorted(score, reverse=True)
        assert [got[q][k + 1][0] for k in range(6)] == [i for _, i in expected]
        assert [got[q][k + 1][1] for k in range(6)] == pytest.approx([s for s, _ in expected], abs=1e-8)


def test_random_draws_are_distinct_complete_and_even(spark):
    train = spark.range(10).select((F.col("id") * 3).alias("train_id"))
    test = spark.range(3000).withColumnRenamed("id", "test_id")
    rows = edges(R.retrieve_random(test, train, 4))
    assert len(rows) == 3000 and all(len(set(v)) == 4 for v in rows.values())
    counts = np.bincount([x // 3 for v in rows.values() for x in v], minlength=10)
    assert abs(counts - 1200).max() < 150
    firsts = np.bincount([v[0] // 3 for v in rows.values()], minlength=10)
    assert abs(firsts - 300).max() < 80
    assert all(sorted(v) == list(range(0, 30, 3)) for v in edges(R.retrieve_random(test.limit(5), train, 99)).values())


def test_fixed_refuses_unknown_ids(spark):
    train = spark.range(5).withColumnRenamed("id", "train_id")
    with pytest.raises(ValueError):
        R.retrieve_fixed(train.withColumnRenamed("train_id", "test_id"), train, [1, 7])


def test_sliding_wraps(spark):
    test = spark.range(6).withColumnRenamed("id", "test_id")
    got = edges(R.retrieve_sliding(test, 3, 6))
    assert got[0] == [3, 4, 5] and got[1] == [4, 5, 0] and got[5] == [2, 3, 4]


def test_diverse_is_greedy_map(vectors):
    data, train = vectors
    test = train.withColumnRenamed("train_id", "test_id").filter("test_id < 6")
    k, cand, scale = 4, 15, 0.5
    got = edges(R.retrieve_diverse(test, train, k, cand, scale))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for i in range(6):
        near = sorted(range(len(data)), key=lambda j: (-round(float(data[i] @ data[j]), 9), -j))[:cand]
        rel = (unit[near] @ unit[i] + 1) / 2
        rel = np.exp((rel - rel.max()) / (2 * scale))
        kernel = rel[:, None] * ((unit[near] @ unit[near].T + 1) / 2) * rel[None, :]
        chosen = []
        while len(chosen) < k:
            best = max((j for j in range(cand) if j not in chosen), key=lambda j: np.linalg.det(kernel[np.ix_(chosen + [j], chosen + [j])]))
            chosen.append(best)
        assert got[i] == [near[j] for j in sorted(chosen, key=lambda j: -rel[j])]


def test_vote_k_walk(vectors):
    data, train = vectors
    k, n, threshold = 5, 8, 0.6
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    votes = {}
    for i in range(len(data)):
        near = sorted((j for j in range(len(data)) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), -j))[:k]
        for j in near:
            votes.setdefault(j, set()).add(i)
    order = sorted(votes, key=lambda j: (-len(votes[j]), j))
    expected = [j for p, j in enumerate(order) if all(len(votes[j] & votes[o]) < threshold * len(votes[j]) for o in order[:p])][:n]
    rows = R.select_vote_k(train, k, n, threshold).collect()
    assert len(rows) == n
    assert sorted(r["train_id"] for r in rows if r["voted"]) == sorted(expected)


def test_vote_k_fills_up(spark):
    train = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "train_id bigint, vec array<double>")
    rows = R.select_vote_k(train, 1, 4, threshold=0.1).collect()
    assert len({r["train_id"] for r in rows}) == 4


def test_empty_test_table(spark, vectors):
    _, train = vectors
    assert R.retrieve_dense(train.withColumnRenamed("train_id", "test_id").limit(0), train, 3).count() == 0


@pytest.mark.parametrize("k, first, train_block", [(1, 1, 7), (3, 2, 10_000), (12, 16, 7), (200, 1, 50)])
def test_bm25_opens_only_what_can_win_and_misses_nothing(spark, k, first, train_block):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61) ** 1.2
    draw = lambda n: " ".join(rng.choice(vocabulary, size=n, p=weight / weight.sum()))
    texts = [draw(int(rng.integers(0, 25))) for _ in range(150)]
    asked = [draw(int(rng.integers(1, 12))) for _ in range(20)] + ["", "w0", "w59 w0 w0", "unknown words"]
    docs = [t.split() for t in texts]
    n, avg = len(docs), np.mean([len(d) for d in docs])
    held = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in held.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    train = spark.createDataFrame(list(enumerate(texts)), "train_id bigint, text string").repartition(5)
    test = spark.createDataFrame(list(enumerate(asked)), "test_id bigint, text string")
    got = {}
    for r in R.retrieve_bm25(test, train, k, first=first, train_block=train_block, short=20 * first).collect():
        got.setdefault(r["test_id"], {})[r["rank"]] = (r["train_id"], r["score"])
    for q, text in enumerate(asked):
        score = [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in text.split()) for d in docs]
        expected = sorted(((round(s, 9), i) for i, s in enumerate(score)), reverse=True)[:k]
        assert [got[q][r + 1][1] for r in range(len(expected))] == pytest.approx([s for s, _ in expected], abs=1e-8)
        clear = [i for s, i in expected if sum(abs(s - x) < 2e-9 for x in score) == 1 or s == 0]
        assert [got[q][r + 1][0] for r, (s, i) in enumerate(expected) if i in clear] == clear and len(got[q]) == len(expected)


def test_bm25_where_common_words_count_against_a_text(spark):
    """Every word stands in most texts, so the mean weight is below zero and texts without a word win."""
    texts = ["a b c", "a b", "a b c", "a c", "b c", "a b c", "x"]
    train = spark.createDataFrame(list(enumerate(texts)), "train_id bigint, text string")
    test = spark.createDataFrame([(0, "a b")], "test_id bigint, text string")
    rows = R.retrieve_bm25(test, train, 7).orderBy("rank").collect()
    assert rows[0]["train_id"] == 6 and rows[0]["score"] == 0 and len({r["train_id"] for r in rows}) == 7
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_best_carries_its_rows_from_block_to_block():
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(7, 90)), 1) + 1e-12 * rng.normal(size=(7, 90))
    scores[2, 5:80], scores[3], scores[:, 40] = np.nan, -np.inf, 7.0
    ids = rng.permutation(90)
    for k in (1, 4, 50, 200):
        for width in (3, 30, 90):
            best = None
            for j in range(0, 90, width):
                best = R._best(best, scores[:, j : j + width], ids[j : j + width], k)
            rounded = np.round(scores, 9) + 0.0
            for i in range(7):
                real = sorted((j for j in range(90) if not np.isnan(scores[i, j])), key=lambda j: (-rounded[i, j], -ids[j]))
                missing = sorted((j for j in range(90) if np.isnan(scores[i, j])), key=lambda j: -ids[j])
                assert best[2][best[0] == i].tolist() == [ids[j] for j in [*real, *missing][:k]]


def test_small_blocks_do_not_multiply_what_travels(spark, vectors):
    """Blocks of 2 by 3 rows copied 120 rows 40 and 60 times."""
    _, train = vectors
    calls = spark.sparkContext.accumulator(0)
    find = lambda tests, trains: calls.add(1) or (lambda a, b: np.ones((len(tests[a]), len(trains[b]))))
    found = R.block_top_k(train.withColumnRenamed("train_id", "test_id"), train, find, 2, test_block=2, train_block=3).collect()
    assert calls.value == 1 and {(r["rank"], r["train_id"]) for r in found} == {(1, 119), (2, 118)}


def test_bm25_sends_the_best_of_a_block_only(spark):
    """Every pair of a test row and a text with one of its words was shuffled."""
    train = spark.range(400).select(F.col("id").alias("train_id"), F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))
    test = spark.range(5).select(F.col("id").alias("test_id"), F.concat(F.lit("common w"), F.col("id")).alias("text"))
    found = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "top_k", lambda df, *a, top_k=R.top_k: found.append(df.count()) or top_k(df, *a))
        rows = R.retrieve_bm25(test, train, 3, train_block=100).collect()
    assert found[0] <= 5 * 3 * 4 and len(rows) == 15
