"""Demonstration retrieval: every retriever returns edges(test_id, rank, train_id[, score])."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.draws import below, bits
from evalmill.functions.text import let, words
from evalmill.operators.ordering import running, top_k
from evalmill.session import pin

# score function: (test rows, train rows) -> function of a slice of each -> matrix test x train
ScoreFn = Callable[[pd.DataFrame, pd.DataFrame], Callable[[slice, slice], np.ndarray]]

EDGES = "test_id bigint, train_id bigint, score double"


def retrieve_none(test: DataFrame) -> DataFrame:
    """No demonstration for any test row."""
    return test.select("test_id", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("train_id")).filter("rank > 0")


def retrieve_fixed(test: DataFrame, train: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The same train ids for all; an id that does not exist raises."""
    found = {r["train_id"] for r in train.filter(F.col("train_id").isin(list(ids))).select("train_id").distinct().collect()}
    missing = sorted(set(ids) - found)
    if missing:
        raise ValueError(f"no such train ids: {missing}")
    return test.select("test_id", F.posexplode(F.array(*[F.lit(i).cast("bigint") for i in ids])).alias("rank", "train_id")).withColumn(
        "rank", F.col("rank") + 1
    )


def draw_distinct(key: Column, total: int, k: int, seed: int) -> Column:
    """Array of k different numbers in [0, total), uniform and reproducible, in random order.

    Floyd's method: step j draws from [0, j] and takes j itself when the draw
    is already there, so exactly k steps are needed whatever k and total are.
    """
    k = min(k, total)
    if k <= 0:
        return F.array().cast("array<bigint>")
    start = F.array().cast("array<bigint>")
    steps = F.sequence(F.lit(total - k).cast("bigint"), F.lit(total - 1).cast("bigint"))

    def step(acc: Column, j: Column) -> Column:
        draw = below(j + 1, seed, key, j)
        return F.array_append(acc, F.when(F.array_contains(acc, draw), j).otherwise(draw))

    drawn = F.aggregate(steps, start, step)
    keyed = F.transform(drawn, lambda x: F.struct(bits(seed + 1, key, x).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def dense_index(df: DataFrame, id_col: str) -> DataFrame:
    """0-based ``idx`` in id order, without a single-task sort."""
    ranked = running(df, [], F.col(id_col), F.col(id_col))
    return ranked.withColumn("idx", F.col("rank") - 1).drop("rank")


def retrieve_random(test: DataFrame, train: DataFrame, k: int, seed: int = 43) -> DataFrame:
    """k different train rows per test row."""
    index = dense_index(train.select("train_id"), "train_id")
    total = train.count()
    drawn = test.select("test_id", F.posexplode(draw_distinct(F.col("test_id"), total, k, seed)).alias("rank", "idx"))
    return drawn.join(index, "idx").select("test_id", (F.col("rank") + 1).alias("rank"), "train_id")


def retrieve_sliding(test: DataFrame, k: int, total: int) -> DataFrame:
    """The k rows before each test row; the first rows wrap to the last ids. Ids are dense places."""
    i = F.col("test_id")
    places = F.sequence(i - k, i - 1)
    return test.select("test_id", F.posexplode(places).alias("rank", "_p")).select(
        "test_id", (F.col("rank") + 1).alias("rank"), F.pmod(F.col("_p"), F.lit(total)).cast("bigint").alias("train_id")
    )


#: Rows of a side that travel together: a table is copied once for every so many rows of the other.
TILE = 16_384


def _best(held: tuple | None, scores: np.ndarray, train_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k train rows per test row of ``scores`` (test x train) and ``held``: places of test rows, scores, train ids.

    The larger id comes first on ties of the rounded score. Only scores that reach the k-th of some
    (of ``held``, or of the largest in equal shares of the columns) are sorted.
    """
    n, m = scores.shape
    low = np.full(n, -np.inf)
    seen = scores
    if np.isnan(scores).any():
        seen = np.where(np.isnan(scores), -np.inf, scores)
    if held is not None:
        full = np.bincount(held[0], minlength=n) >= k
        last = np.full(n, np.inf)
        np.minimum.at(last, held[0], np.where(np.isnan(held[1]), -np.inf, held[1]))
        low[full] = last[full]
    if m >= k and not np.isfinite(low).all():
        share = max(1, m // (4 * k))
        parts = m // share
        most = seen[:, : share * parts].reshape(n, share, parts).max(axis=1)
        low = np.maximum(low, np.partition(most, parts - k, axis=1)[:, parts - k])
    # scores that round to the same are closer than this
    low = np.where(np.isfinite(low), low - 2e-9 - 4e-15 * np.abs(low), low)
    test, train = np.nonzero(seen >= low[:, None])
    values, ids = np.round(scores[test, train], 9) + 0.0, train_ids[train]
    if held is not None:
        test, values, ids = (np.concatenate(x) for x in zip(held, (test, values, ids)))
    order = np.lexsort((-ids, -values, test))
    test = test[order]
    place = np.arange(len(test)) - np.searchsorted(test, test)
    order = order[place < k]
    return test[place < k], values[order], ids[order]


def block_top_k(
    test: DataFrame, train: DataFrame, score: ScoreFn, k: int, test_block: int = 1024, train_block: int = 8192, direct: int | None = None
) -> DataFrame:
    """Exact top k of ``score`` without one row per (test, train) pair.

    Both tables are cut into tiles of about ``TILE`` rows (whole blocks) and every train tile meets
    every test tile in a task of its own. There a test block is scored against one train block after
    the other, carrying its best k; one ranking merges the tiles. ``direct`` is still taken from
    callers and changes nothing.
    """
    tiles = lambda df, block: math.ceil(max(df.count(), 1) / (block * max(1, TILE // block)))
    q, t = tiles(test, test_block), tiles(train, train_block)
    place = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = test.withColumn("_q", place("test_id", q)).withColumn("_t", every(t))
    right = train.withColumn("_t", place("train_id", t)).withColumn("_q", every(q))

    def meet(tests, trains):
        if not len(tests) or not len(trains):
            return pd.DataFrame({"test_id": [], "train_id": [], "score": []})
        scored = score(tests, trains)
        test_ids, train_ids = tests["test_id"].to_numpy(), trains["train_id"].to_numpy()
        out = []
        for i in range(0, len(tests), test_block):
            best = None
            for j in range(0, len(trains), train_block):
                best = _best(best, scored(slice(i, i + test_block), slice(j, j + train_block)), train_ids[j : j + train_block], k)
            out.append(pd.DataFrame({"test_id": test_ids[i : i + test_block][best[0]], "train_id": best[2], "score": best[1]}))
        return pd.concat(out)

    found = left.groupBy("_q", "_t").cogroup(right.groupBy("_q", "_t")).applyInPandas(meet, EDGES)
    return top_k(found, ["test_id"], [F.desc("score"), F.desc("train_id")], k)


def _stack(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def retrieve_dense(test: DataFrame, train: DataFrame, k: int, normalise: bool = False, skip_self: bool = False, **blocks) -> DataFrame:
    """Exact inner product (cosine when normalised) over ``vec`` columns."""

    def score(tests, trains):
        a, b = _stack(trains["vec"]), _stack(tests["vec"])
        if normalise:
            a = a / np.linalg.norm(a, axis=1, keepdims=True)
            b = b / np.linalg.norm(b, axis=1, keepdims=True)
        train_ids, test_ids = trains["train_id"].to_numpy(), tests["test_id"].to_numpy()

        def piece(test: slice, train: slice) -> np.ndarray:
            out = b[test] @ a[train].T
            if skip_self:
                out[test_ids[test][:, None] == train_ids[train][None, :]] = -np.inf
            return out

        return piece

    found = block_top_k(test, train, score, k + (1 if skip_self else 0), **blocks)
    return found.filter((F.col("rank") <= k) & (F.col("score") > float("-inf")))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf): the tokens are sorted once and counted by the ends of equal stretches."""

    def counted(s: Column) -> Column:
        last = lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1))
        ends = F.filter(F.transform(s, lambda _, i: i + 1), last)
        pair = lambda es: lambda e, j: F.struct(F.get(s, e - 1).alias("term"), (e - F.coalesce(F.get(es, j - 1), F.lit(0))).alias("tf"))
        return let(ends, lambda es: F.transform(es, pair(es)))

    return let(F.sort_array(tokens), counted)


def postings(train: DataFrame) -> DataFrame:
    """Inverted index (term, train_id, tf, length) of ``text``, written once. A text stays in its task."""
    tokens = train.select("train_id", words(F.col("text")).alias("tokens"))
    pairs = tokens.select("train_id", F.size("tokens").alias("length"), F.explode(term_counts(F.col("tokens"))).alias("p"))
    return pin(pairs.select("p.term", "train_id", "p.tf", "length"))


def retrieve_bm25(
    test: DataFrame, train: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, test_block: int = 1024, train_block: int = 8192, **_: int
) -> DataFrame:
    """Okapi BM25 over lower-case words of ``text`` by postings; the larger train id first on ties.

    A term in more than half of the texts gets ``floor`` times the mean idf. The postings of asked
    terms are cut into blocks of about ``train_block`` texts (``TEXTS`` at most), which meet every
    block of ``test_block`` test rows in a task of its own: sums are taken there, and only the best k
    of a block leave it. Texts without a word of the test row score 0 and fill up, largest id first.
    ``first`` and ``short`` are still taken from callers and change nothing.
    """
    index = postings(train)
    n = train.count()
    total = index.agg(F.sum("tf")).first()[0] or 0
    mean_len = total / n if total else 1.0
    held = pin(index.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = held.agg(F.avg(raw)).first()[0] or 0.0
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean_len))

    asked = test.select("test_id", F.explode(term_counts(words(F.col("text")))).alias("p")).select("test_id", "p.term", F.col("p.tf").alias("times"))
    idf = F.when(raw < 0, floor * mean_idf).otherwise(raw)
    weighed = asked.filter("test_id is not null").join(held, "term")
    weights = pin(weighed.groupBy("test_id", "term").agg(F.sum(F.col("times") * idf).alias("w")))
    # short numbers travel instead of terms
    terms = pin(weights.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))

    q, t = math.ceil(max(test.count(), 1) / test_block), math.ceil(max(n, 1) / min(train_block, TEXTS))
    place = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weights.join(terms, "term").select(F.col("test_id").cast("bigint").alias("test_id"), F.col("no").alias("no"), "w", place("test_id", q).alias("_q"), every(t).alias("_t"))
    right = index.join(terms, "term").select(F.col("train_id").cast("bigint").alias("train_id"), F.col("no").alias("no"), gain.alias("gain"), place("train_id", t).alias("_t"), every(q).alias("_q"))
    found = left.groupBy("_q", "_t").cogroup(right.groupBy("_q", "_t")).applyInArrow(lambda a, b: _posting_scores(a, b, k), EDGES)
    best = pin(top_k(found, ["test_id"], [F.desc("score"), F.desc("train_id")], k).drop("rank"))

    def met(some: DataFrame) -> DataFrame:
        """All pairs of these test rows with a text that has one of their terms."""
        own = weights.join(some.distinct(), "test_id", "left_semi")
        return own.join(index, "term").select("test_id", "train_id").distinct()

    return fill_up(test, train, met, best, k)


#: Texts of a block of postings, whatever the caller asks: their scores are one matrix.
TEXTS = 8192


def _posting_scores(asked: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """Best k pairs (test_id, train_id, score) of the weights (test_id, no, w) and postings (train_id, no, gain) of two blocks.

    Rows of one id, or of no train id, count as one text.
    """
    if not len(asked) or not len(postings):
        return pa.table({"test_id": pa.array([], pa.int64()), "train_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    none = np.iinfo(np.int64).min + 1
    coded = lambda c: c.combine_chunks().dictionary_encode("encode")
    tests, texts = coded(asked["test_id"]), coded(postings["train_id"])
    test_ids = tests.dictionary.to_numpy()
    train_ids = texts.dictionary.fill_null(none).to_numpy()
    order = np.argsort(asked["no"].to_numpy(), kind="stable")
    number, row, w = asked["no"].to_numpy()[order], tests.indices.to_numpy()[order], asked["w"].to_numpy()[order]
    held, code = np.unique(postings["no"].to_numpy(), return_inverse=True)
    cells, code = np.unique(code * len(train_ids) + texts.indices.to_numpy(), return_inverse=True)
    gain, column = np.bincount(code, postings["gain"].to_numpy()), cells % len(train_ids)
    ends = np.searchsorted(cells, np.arange(len(held) + 1) * len(train_ids))
    scores = np.full((len(test_ids), len(train_ids)), -np.inf)
    for no, low, high in zip(held, ends, ends[1:]):
        a, b = slice(*np.searchsorted(number, [no, no + 1])), slice(low, high)
        at = np.ix_(row[a], column[b])
        old = scores[at]
        scores[at] = np.where(np.isneginf(old), 0.0, old) + np.outer(w[a], gain[b])
    test, values, ids = _best(None, scores, train_ids, k)
    met = values > -np.inf
    ids = ids[met]
    return pa.table({"test_id": test_ids[test[met]], "train_id": pa.array(ids, mask=ids == none), "score": values[met]})


def fill_up(test: DataFrame, train: DataFrame, met: Callable[[DataFrame], DataFrame], best: DataFrame, k: int) -> DataFrame:
    """Rows of score 0 for tests with fewer than k positive scores, from the largest train ids they have no score with.

    ``met`` gives the pairs with a score of some test rows.
    """
    rich = best.filter("score > 0").groupBy("test_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    poor = pin(test.select("test_id").join(rich, "test_id", "left_anti"))
    if poor.isEmpty():
        return top_k(best, ["test_id"], [F.desc("score"), F.desc("train_id")], k)
    taken = met(poor).join(poor, "test_id").select("test_id", "train_id")
    counts = pin(poor.join(taken.groupBy("test_id").agg(F.count(F.lit(1)).alias("n")), "test_id", "left").fillna(0, ["n"]))
    last = train.select("train_id").orderBy(F.desc("train_id")).limit(k + counts.agg(F.max("n")).first()[0])
    last = last.withColumn("place", F.row_number().over(Window.orderBy(F.desc("train_id"))))
    # among the last k + n texts at least k have none of the n scores
    zeros = counts.select("test_id", F.explode(F.sequence(F.lit(1), (F.col("n") + k).cast("int"))).alias("place")).join(last, "place")
    zeros = zeros.join(taken, ["test_id", "train_id"], "left_anti").select("test_id", "train_id", F.lit(0.0).alias("score"))
    zeros = top_k(zeros, ["test_id"], [F.desc("train_id")], k).drop("rank")
    return top_k(best.unionByName(zeros), ["test_id"], [F.desc("score"), F.desc("train_id")], k)


def retrieve_diverse(test: DataFrame, train: DataFrame, k: int, candidates: int = 100, scale: float = 0.1, **blocks) -> DataFrame:
    """Diverse subset of the nearest candidates: greedy choice for a determinantal point process, ordered by relevance.

    A group holds one test row's ``candidates`` vectors.
    """
    near = retrieve_dense(test, train, candidates, **blocks)
    rows = near.join(train.withColumnRenamed("vec", "_b"), "train_id").join(test.withColumnRenamed("vec", "_a"), "test_id")

    def choose(key, pdf):
        pdf = pdf.sort_values("rank")
        a, b = np.asarray(pdf["_a"].iloc[0], dtype=np.float64), _stack(pdf["_b"])
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b, axis=1, keepdims=True)
        relevance = (b @ a + 1) / 2
        relevance = np.exp((relevance - relevance.max()) / (2 * scale))
        kernel = relevance[:, None] * ((b @ b.T + 1) / 2) * relevance[None, :]
        chosen: list[int] = []
        basis = np.zeros((0, len(b)))
        gain = np.diag(kernel).copy()
        while len(chosen) < min(k, len(b)):
            gain[chosen] = -np.inf
            best = int(np.argmax(gain))
            chosen.append(best)
            row = (kernel[best] - basis[:, best] @ basis) / math.sqrt(max(gain[best], 1e-12))
            basis = np.vstack([basis, row])
            gain = gain - row * row
        chosen.sort(key=lambda i: (-relevance[i], i))
        ids = pdf["train_id"].to_numpy()
        return pd.DataFrame({"test_id": key[0], "rank": range(1, len(chosen) + 1), "train_id": ids[chosen], "score": relevance[chosen]})

    columns = rows.select("test_id", "rank", "train_id", "_a", "_b")
    return columns.groupBy("test_id").applyInPandas(choose, "test_id bigint, rank int, train_id bigint, score double")


def select_vote_k(train: DataFrame, k: int, n: int, threshold: float = 1.0, seed: int = 0, **blocks) -> DataFrame:
    """n train ids for all tests: each vector votes for its k nearest others, most votes first.

    A candidate is passed over when a candidate before it (in vote order) shares at
    least ``threshold`` of its voters; hash order fills up. Voters are compared by a
    join on the voter, who has only k votes.
    """
    votes = retrieve_dense(train.withColumnRenamed("train_id", "test_id"), train, k, normalise=True, skip_self=True, **blocks)
    # counted, compared with each other and filled up: searched once
    votes = pin(votes.select(F.col("test_id").alias("voter"), F.col("train_id").alias("cand")))
    counts = votes.groupBy("cand").agg(F.count(F.lit(1)).alias("votes"))
    marked = votes.join(counts, "cand")
    a, b = marked.alias("a"), marked.alias("b")
    earlier = (F.col("b.votes") > F.col("a.votes")) | ((F.col("b.votes") == F.col("a.votes")) & (F.col("b.cand") < F.col("a.cand")))
    shared = a.join(b, (F.col("a.voter") == F.col("b.voter")) & earlier).groupBy(
        F.col("a.cand").alias("cand"), F.col("b.cand").alias("other"), F.col("a.votes").alias("votes")
    ).agg(F.count(F.lit(1)).alias("both"))
    rejected = shared.filter(F.col("both") >= threshold * F.col("votes")).select("cand").distinct()
    kept = counts.join(rejected, "cand", "left_anti").orderBy(F.desc("votes"), "cand").limit(n)
    kept = kept.select(F.col("cand").alias("train_id"), F.lit(0).alias("_part"), (-F.col("votes")).alias("_o"))
    rest = train.select("train_id").join(kept, "train_id", "left_anti").select(
        "train_id", F.lit(1).alias("_part"), bits(seed, "train_id").alias("_o")
    )
    first = kept.unionByName(rest).orderBy("_part", "_o", "train_id").limit(n)
    return first.select("train_id", (F.col("_part") == 0).alias("voted"))
