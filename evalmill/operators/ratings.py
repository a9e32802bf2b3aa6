"""Ratings from battles: Bradley-Terry, bootstrap intervals, style control, online Elo."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.draws import uniform
from evalmill.operators.ordering import SLOT_ROWS
from evalmill.session import pin, scratch_path

MAX_MODELS = 3000


def pair_counts(battles: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Battles to (model_a, model_b, outcome, n): at most 3 x models^2 rows per pool, combined before the shuffle."""
    outcome = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    return battles.groupBy(*by, "model_a", "model_b", outcome.alias("outcome")).agg(total.cast("double").alias("n"))


def _fit(a: np.ndarray, b: np.ndarray, outcome: np.ndarray, weight: np.ndarray, n_models: int) -> np.ndarray:
    """Mean-zero maximum likelihood ratings (natural scale, base 10) by Newton steps on the pair matrix."""
    alpha = math.log(10.0)
    ratings = np.zeros(n_models)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(alpha * (ratings[a] - ratings[b]), -35, 35)))
        slope = alpha * weight * (outcome - p)
        grad = np.bincount(a, slope, n_models) - np.bincount(b, slope, n_models)
        curve = alpha * alpha * weight * p * (1 - p)
        hessian = np.zeros((n_models, n_models))
        np.add.at(hessian, (a, a), curve)
        np.add.at(hessian, (b, b), curve)
        np.add.at(hessian, (a, b), -curve)
        np.add.at(hessian, (b, a), -curve)
        # the added constant fixes the free level, the tiny ridge parts that never meet
        step = np.linalg.solve(hessian + 1.0 / n_models + 1e-9 * max(weight.sum(), 1.0) * np.eye(n_models), grad)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-300))
        ratings = ratings + step
        if np.abs(step).max() < 1e-10:
            break
    return ratings - ratings.mean()


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest model index each model is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _scaled(ratings: np.ndarray, models: list, baseline: str | None, baseline_rating: float) -> np.ndarray:
    scaled = ratings * 400.0 + 1000.0
    return scaled + (baseline_rating - scaled[models.index(baseline)]) if baseline in models else scaled


def _indexed(pdf: pd.DataFrame):
    models = sorted(set(pdf["model_a"]) | set(pdf["model_b"]))
    if len(models) > MAX_MODELS:
        raise ValueError(f"{len(models)} models in one pool, more than {MAX_MODELS}")
    place = {m: i for i, m in enumerate(models)}
    return models, pdf["model_a"].map(place).to_numpy(), pdf["model_b"].map(place).to_numpy()


def _with_pool(counts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (counts, list(by)) if by else (counts.withColumn("_pool", F.lit(0)), ["_pool"])


def _types(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in names)


def bradley_terry(counts: DataFrame, by: Sequence[str] = (), baseline: str | None = None, baseline_rating: float = 1000.0) -> DataFrame:
    """Ratings per pool from pair counts; models in different ``component``s never met, even indirectly.

    The fit sees only the pair matrix (models^2), whatever the number of battles.
    """
    rows, keys = _with_pool(counts, by)

    def fit(key, pdf):
        models, a, b = _indexed(pdf)
        ratings = _fit(a, b, pdf["outcome"].to_numpy(), pdf["n"].to_numpy(), len(models))
        parts = _components(a, b, len(models))
        out = pd.DataFrame(
            {"model": models, "rating": _scaled(ratings, models, baseline, baseline_rating), "component": [models[i] for i in parts]}
        )
        for name, value in zip(keys, key):
            out.insert(0, name, value)
        return out[[*keys, "model", "rating", "component"]]

    schema = _types(rows, keys) + "model string, rating double, component string"
    out = rows.groupBy(*keys).applyInPandas(fit, schema)
    return out if by else out.drop("_pool")


def bootstrap_bradley_terry(
    counts: DataFrame, by: Sequence[str] = (), rounds: int = 100, seed: int = 0, baseline: str | None = None, baseline_rating: float = 1000.0
) -> DataFrame:
    """Ratings of ``rounds`` multinomial resamples of the pair counts; one small task group per round."""
    rows, keys = _with_pool(counts, by)
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))

    def fit(key, pdf):
        pdf = pdf.sort_values(["model_a", "model_b", "outcome"])
        models, a, b = _indexed(pdf)
        n = pdf["n"].to_numpy()
        rng = np.random.default_rng([seed, int(key[-1])])
        drawn = rng.multinomial(int(round(n.sum())), n / n.sum()).astype(float)
        ratings = _fit(a, b, pdf["outcome"].to_numpy(), drawn, len(models))
        out = pd.DataFrame({"model": models, "rating": _scaled(ratings, models, baseline, baseline_rating)})
        for name, value in zip([*keys, "round"], key):
            out.insert(0, name, value)
        return out[[*keys, "round", "model", "rating"]]

    out = rows.groupBy(*keys, "round").applyInPandas(fit, _types(rows, keys) + "round int, model string, rating double")
    return out if by else out.drop("_pool")


def intervals(rounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """2.5 %, 50 % and 97.5 % points and spread of the resampled ratings."""
    q = lambda p: F.percentile("rating", F.lit(p))
    return rounds.groupBy(*by, "model").agg(
        q(0.5).alias("rating"), q(0.025).alias("lower"), q(0.975).alias("upper"), F.stddev_pop("rating").alias("std")
    )


def confidence_rank(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 + number of models whose lower bound is above my upper bound (a join over the few models)."""
    other = ratings.select(*by, F.col("lower").alias("_lower"), F.col("model").alias("_m"))
    above = F.col("_lower") > F.col("upper")
    for c in by:
        above = above & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    left = ratings.alias("x")
    joined = left.join(other.alias("y"), above, "left")
    cols = [F.col(f"x.{c}").alias(c) for c in ratings.columns]
    return joined.groupBy(*cols).agg((F.count("_m") + 1).cast("int").alias("rank"))


def battles_per_model(battles: DataFrame) -> DataFrame:
    sides = battles.select(F.explode(F.array("model_a", "model_b")).alias("model"))
    return sides.groupBy("model").agg(F.count(F.lit(1)).alias("battles"))


def expected_win_rates(ratings: DataFrame, base: str | None = None) -> DataFrame:
    """1 / (1 + 10^((Rb - Ra) / 400)) for every pair of models, or against ``base`` only."""
    a = ratings.select(F.col("model").alias("model_a"), F.col("rating").alias("_ra"))
    b = ratings.select(F.col("model").alias("model_b"), F.col("rating").alias("_rb"))
    if base:
        b = b.filter(F.col("model_b") == base)
    pairs = a.join(b, F.col("model_a") != F.col("model_b"))
    win = 1 / (1 + F.pow(F.lit(10.0), (F.col("_rb") - F.col("_ra")) / 400))
    return pairs.select("model_a", "model_b", win.alias("win_rate"))


def style_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1)."""
    return (a - b) / (a + b + 1)


def style_controlled(
    battles: DataFrame, styles: Sequence[tuple[str, str, str]], controls: Sequence[str] = (), reg: float = 0.5, baseline: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bradley-Terry with style differences and one-hot controls, as a distributed logistic regression.

    ``styles`` are (name, column of a, column of b). A tie counts as half a win
    and half a loss. Returns ratings(model, rating) and odds ratios(feature, odds_ratio).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    names = battles.select(F.explode(F.array("model_a", "model_b")).alias("m")).distinct().limit(MAX_MODELS + 1).collect()
    models = sorted(r["m"] for r in names)
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    levels = {c: sorted(r[0] for r in battles.select(c).distinct().limit(MAX_MODELS + 1).collect()) for c in controls}
    if any(len(v) > MAX_MODELS for v in levels.values()):
        raise ValueError(f"a control has more than {MAX_MODELS} levels")

    diffs = battles.select("*", *[style_difference(F.col(a), F.col(b)).alias(f"_d_{n}") for n, a, b in styles])
    aggs = [f(F.col(f"_d_{n}")).alias(f"{k}_{n}") for n, _, _ in styles for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = diffs.agg(F.count(F.lit(1)).alias("n"), *aggs).first()

    alpha = math.log(10.0)
    parts = [(F.when(F.col("model_a") == m, alpha).otherwise(0.0) - F.when(F.col("model_b") == m, alpha).otherwise(0.0)) for m in models]
    parts += [(F.col(f"_d_{n}") - float(moments[f"m_{n}"])) / float(moments[f"s_{n}"] or 1.0) for n, _, _ in styles]
    parts += [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c in controls for v in levels[c]]
    features = [*models, *[n for n, _, _ in styles], *[f"{c}={v}" for c in controls for v in levels[c]]]

    sides = F.when(F.col("winner") == "model_a", F.array(F.struct(F.lit(1.0).alias("label"), F.lit(1.0).alias("w"))))
    sides = sides.when(F.col("winner") == "model_b", F.array(F.struct(F.lit(0.0).alias("label"), F.lit(1.0).alias("w"))))
    sides = sides.otherwise(
        F.array(F.struct(F.lit(1.0).alias("label"), F.lit(0.5).alias("w")), F.struct(F.lit(0.0).alias("label"), F.lit(0.5).alias("w")))
    )
    rows = diffs.select(array_to_vector(F.array(*parts)).alias("features"), F.explode(sides).alias("_y")).select("features", "_y.*")
    fit = LogisticRegression(
        weightCol="w", fitIntercept=False, standardization=False, regParam=reg / float(moments["n"]), elasticNetParam=0.0, maxIter=100, tol=1e-9
    ).fit(rows)
    values = np.array(fit.coefficients.toArray())
    spark = battles.sparkSession
    scaled = _scaled(values[: len(models)], models, baseline, 1000.0)
    ratings = spark.createDataFrame([(m, float(r)) for m, r in zip(models, scaled)], "model string, rating double")
    odds = [(n, float(math.exp(v))) for n, v in zip(features[len(models):], values[len(models):])]
    return ratings, spark.createDataFrame(odds, "feature string, odds_ratio double")


#: Battles of a pool that one pass walks about.
PASS_ROWS = 4_000_000

#: Battles that a task packs together, and output rows that it builds at once.
PACK_ROWS, OUT_ROWS = 1_000_000, 10_000

PIECE = "model_a array<string>, model_b array<string>, won array<double>, games binary"


def ranged(battles: DataFrame, columns: Sequence[str], times: int = 1) -> DataFrame:
    """Partitions that are ranges of ``columns``, in order and sorted, about ``SLOT_ROWS`` rows each when a row is copied ``times`` times."""
    least = int(battles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-battles.count() * times // SLOT_ROWS))
    return battles.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns)


def _codes(column: pa.Array, place: dict) -> np.ndarray:
    """The numbers of the values in ``place``, which takes up new ones."""
    found = column.dictionary_encode("encode")
    return np.array([place.setdefault(v, len(place)) for v in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]


def _packed(keys: Sequence[str], chunk: int):
    """Rows in order to pieces of ``chunk`` battles of one pool at most: a list of the different battles, and the number of each in turn.

    ``_at`` numbers the pieces in order: by range, and inside it as they come.
    """

    def pieces(pool, a, b, won, pools, models):
        pool = pool.astype(np.min_scalar_type(len(pools)))  # numbers this short are sorted by their digits
        by_pool = np.argsort(pool, kind="stable")
        pool, game = pool[by_pool], ((a * len(models) + b) * 3 + won)[by_pool]
        cuts = [0, *(np.flatnonzero(pool[1:] != pool[:-1]) + 1), len(pool)]
        for low, high in zip(cuts, cuts[1:]):
            for first in range(low, high, chunk):
                found = pa.array(game[first : min(first + chunk, high)]).dictionary_encode()
                pair, points = np.divmod(found.dictionary.to_numpy(), 3)
                sides = np.divmod(pair, len(models))
                games = found.indices.to_numpy().astype(np.min_scalar_type(len(pair) - 1))
                yield [*pools[pool[low]], len(games), *([models[i] for i in side] for side in sides), points / 2, games.tobytes()]

    def pack(batches):
        at = TaskContext.get().partitionId() << 33
        held, n, pools, models, types = [], 0, {}, {}, []

        def ended():
            nonlocal at
            rows = pieces(*map(np.concatenate, zip(*held)), list(pools), list(models))
            while some := list(islice(rows, OUT_ROWS)):
                columns = [pa.array(c, t) for c, t in zip(zip(*some), types)]
                names = [*keys, "_n", "model_a", "model_b", "won", "games"]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), *columns], ["_at", *names])
                at += len(some)

        for batch in filter(len, batches):
            texts = pa.list_(pa.string())
            types = [*(batch.schema.field(c).type for c in keys), pa.int64(), texts, texts, pa.list_(pa.float64()), pa.binary()]
            key = [batch.column(c).dictionary_encode() for c in keys]
            code = np.zeros(len(batch), np.int64)
            for k in key:
                code = np.unique(code * len(k.dictionary) + k.indices.to_numpy(), return_inverse=True)[1]
            _, one, code = np.unique(code, return_index=True, return_inverse=True)
            named = [pools.setdefault(tuple(k[int(i)].as_py() for k in key), len(pools)) for i in one]
            won = (2 * batch.column("won").to_numpy()).astype(np.int64)
            held.append((np.array(named, np.int64)[code], *(_codes(batch.column(c), models) for c in ("model_a", "model_b")), won))
            n += len(batch)
            if n >= PACK_ROWS:
                yield from ended()
                held, n, pools, models = [], 0, {}, {}
        if held:
            yield from ended()

    return pack


def online_elo(
    battles: DataFrame, by: Sequence[str], order: str, tie: str, k: float = 4.0, chunk: int = 1_000_000, start: float = 1000.0, in_place: bool = False
) -> DataFrame:
    """Sequential Elo per pool (base 10, scale 400).

    The result depends on the order of the battles. They are sorted by ranges
    (``in_place``: they come ``ranged``, at least inside each pool) and packed
    into pieces of ``chunk`` battles of a pool at most, so only a few bytes a
    battle are dealt by pool. A pool is walked in passes of as many pieces as
    ``PASS_ROWS`` holds (one at least): Python holds one batch and the ratings,
    and only the ratings (pools x models) are carried to the next pass. Battles
    whose pool is null are left out.
    """
    keys = list(by)
    spark = battles.sparkSession
    won = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    rows = battles.dropna(subset=keys) if keys else battles
    rows = rows if in_place else ranged(rows.select(*dict.fromkeys([*keys, order, tie, "model_a", "model_b", "winner"])), [*keys, order, tie])
    rows = rows.select(*keys, "model_a", "model_b", won.alias("won"))
    pieces = pin(rows.mapInArrow(_packed(keys, chunk), f"_at bigint, {_types(rows, keys)}_n bigint, {PIECE}"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    size = chunk * max(1, PASS_ROWS // chunk)
    placed = pieces.join(heads, "_at").drop("_at", "_n").withColumn("_pass", F.floor(F.col("_first") / size).cast("int"))
    # stored by pass: a pass reads its own battles and nothing else
    path = scratch_path(spark, "pieces")
    placed.hint("rebalance", "_pass").write.partitionBy("_pass").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    last = placed.agg(F.max("_pass")).first()[0]
    schema = _types(rows, keys) + "model string, rating double"

    def walk(batches):
        key, place, rating = None, {}, []
        kinds: list = []

        def ended():
            columns = [*([v] * len(rating) for v in key), list(place), rating]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string(), pa.float64()])], [*keys, "model", "rating"])

        def at(model):
            if model not in place:
                place[model] = len(rating)
                rating.append(start)
            return place[model]

        for batch in filter(len, batches):
            kinds = [batch.schema.field(c).type for c in keys]
            columns = [batch.column(c) for c in ("model_a", "model_b", "won", "games")]
            for i in range(len(batch)):
                this = tuple(batch.column(c)[i].as_py() for c in keys)
                if this != key:
                    if key is not None:
                        yield ended()
                    key, place, rating = this, {}, []
                a, b, won, games = (c[i].as_py() for c in columns)
                # ratings of the pass before come first
                if games is None:
                    for model, value in zip(a, won):
                        rating[at(model)] = value
                    continue
                battle = [(at(x), at(y), w) for x, y, w in zip(a, b, won)]
                numbers = np.frombuffer(games, np.min_scalar_type(len(battle) - 1)).tolist()
                for x, y, w in map(battle.__getitem__, numbers):
                    rx, ry = rating[x], rating[y]
                    step = k * (w - 1.0 / (1.0 + 10.0 ** ((ry - rx) / 400.0)))
                    rating[x] = rx + step
                    rating[y] = ry - step
        if key is not None:
            yield ended()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    state = spark.createDataFrame([], schema)
    for i in range((last if last is not None else -1) + 1):
        games = placed.filter(F.col("_pass") == i).drop("_pass")
        held = {"_first": F.lit(-1).cast("bigint"), "model_a": F.array("model"), "won": F.array("rating")}
        held = state.select(*keys, *[held.get(c, F.lit(None).cast(t)).alias(c) for c, t in games.dtypes if c not in keys])
        state = held.unionByName(games).repartition(tasks, *keys).sortWithinPartitions(*keys, "_first").mapInArrow(walk, schema)
        if i < last:
            state = pin(state)
    return state


def poisson_cuts() -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ...: as many values as a draw of 52 bits can tell apart."""
    cuts, total, term = [], 0.0, math.exp(-1.0)
    while total < 1 - 2.0**-52:
        total += term
        cuts.append(total)
        term /= len(cuts)
        if len(cuts) == 20:
            break
    return cuts


def bootstrap_elo(battles: DataFrame, order: str, tie: str, rounds: int = 100, seed: int = 0, **elo) -> DataFrame:
    """Elo over ``rounds`` resamples, each battle repeated by a hashed Poisson(1) count; all rounds at once.

    Battles are sorted once, before they are copied, as all rounds keep their order.
    """
    cuts = poisson_cuts()
    # how many cuts are not above the draw
    copies = F.when(F.col("_draw") < cuts[0], 0)
    for i, cut in enumerate(cuts[1:], 1):
        copies = copies.when(F.col("_draw") < cut, i)
    rows = ranged(battles, [order, tie], rounds).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    # a draw is two hashes: taken once a battle and round, in a column of its own, as a lambda function would not be compiled
    rows = rows.withColumn("_draw", uniform(seed, "round", order, tie))
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.otherwise(len(cuts)))))
    return online_elo(rows, ["round"], order, tie, in_place=True, **elo)
