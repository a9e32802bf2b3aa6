"""Metrics over repeated samples: pass@k, G-pass@k, run averages, majority vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.operators.ordering import dealt


def outcome_counts(df: DataFrame, by, key="item_id", right="right") -> DataFrame:
    """Per item: samples ``n`` and right ones ``c``."""
    return df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right)).alias("c"))


def solved(tests: DataFrame, keys: Sequence[str], result="result") -> DataFrame:
    """Test outcomes to one row per sample: right when every test is above 0."""
    return tests.groupBy(*keys).agg((F.min(result) > 0).alias("right"))


def _product(k: int, factor) -> Column:
    out = F.lit(1.0)
    for j in range(k):
        out = out * factor(j)
    return out


def _choose(n: Column, k: int) -> Column:
    """n over k for a small fixed k, 0 when k > n."""
    return F.when(n >= k, _product(k, lambda j: (n - j) / F.lit(float(j + 1)))).otherwise(0.0)


def pass_at_k(counts: DataFrame, by, ks: Sequence[int]) -> DataFrame:
    """Chance that k drawn samples hold a right one, averaged over items, times 100.

    Null for a slice in which an item has fewer than k samples. The chance of
    no right one is a product of k ratios, whatever n is.
    """
    n, c = F.col("n"), F.col("c")
    out = []
    for k in ks:
        none_right = F.when(n - c < k, 0.0).otherwise(_product(k, lambda j: (n - c - j) / (n - j)))
        out.append(F.when(F.min(n) >= k, F.avg(1 - none_right) * 100).alias(f"pass@{k}"))
    return counts.groupBy(*by).agg(*out)


def _at_least(n: Column, c: Column, k: int, m: int) -> Column:
    """P(X >= m) of a hypergeometric draw of k out of n with c right."""
    total = F.lit(0.0)
    for i in range(m, k + 1):
        total = total + _choose(c, i) * _choose(n - c, k - i)
    return F.when(n >= k, total / F.greatest(_choose(n, k), F.lit(1.0))).otherwise(0.0)


def g_pass_at_k(counts: DataFrame, by, k: int, thresholds: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """G-pass@k at each threshold and their mean mG-pass@k, times 100; items with fewer than k samples count as 0.

    Every distinct (n, c) is worked out once; there are few of those.
    """
    from math import ceil

    small = counts.groupBy(*by, "n", "c").agg(F.count(F.lit(1)).alias("_w"))
    n, c, w = F.col("n"), F.col("c"), F.col("_w")
    mean = lambda x: F.sum(x * w) / F.sum(w) * 100
    columns = [
        mean(_at_least(n, c, k, max(ceil(k * t), 1))).alias(f"g_pass@{k}_{t}") for t in thresholds
    ]
    upper = F.lit(0.0)
    for i in range(ceil(k / 2) + 1, k + 1):
        upper = upper + _at_least(n, c, k, i)
    return small.groupBy(*by).agg(*columns, mean(upper * 2 / k).alias(f"mg_pass@{k}"))


def run_average(df: DataFrame, by, runs: int, replica="replica", score="score", metric="accuracy") -> DataFrame:
    """Mean over replicas of the per-replica mean, named after the number of runs when there are several."""
    per = df.groupBy(*by, replica).agg(F.avg(score).alias("_s"))
    name = f"{metric} ({runs} runs average)" if runs > 1 else metric
    return per.groupBy(*by).agg(F.avg("_s").alias("score")).withColumn("metric", F.lit(name))


def subdivision_scores(df: DataFrame, by, subdivision="subdivision", score="score") -> DataFrame:
    """Mean times 100 per subdivision and over all, one pass."""
    sets = [[*by, subdivision], list(by)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *by, subdivision).agg(
        (F.avg(score) * 100).alias("score"), F.grouping(subdivision).alias("_all")
    )
    return out.withColumn(subdivision, F.when(F.col("_all") == 1, "overall").otherwise(F.col(subdivision))).drop("_all")


def majority_vote(df: DataFrame, keys: Sequence[str], answer="answer", pos="pos") -> DataFrame:
    """Most frequent answer per key; on ties the one seen first."""
    counts = dealt(df.select(*dict.fromkeys([*keys, answer, pos])), keys).groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = F.max_by(F.col(answer), F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(*keys).agg(best.alias("vote"))
