"""Joins between predictions, items, models and judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(preds: DataFrame, items: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Predictions with their items. Ids that do not meet are reported by ``check_complete``."""
    return preds.join(items, list(keys))


def check_complete(preds: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Per model: items without prediction, predictions without item, and whether it is complete."""
    have = preds.select("model", key).distinct()
    n_items = items.agg(F.countDistinct(key).alias("items"))
    marked = have.join(items.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    counts = marked.groupBy("model").agg(
        F.count_if(F.col("known")).alias("matched"), F.count_if(F.col("known").isNull()).alias("extra")
    )
    # one row of items counts meets a handful of models
    return counts.join(n_items, F.lit(True)).select(
        "model",
        (F.col("items") - F.col("matched")).alias("missing"),
        "extra",
        ((F.col("items") == F.col("matched")) & (F.col("extra") == 0)).alias("complete"),
    )


def unmatched_ids(preds: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Ids on one side only."""
    left = preds.select(key).distinct().withColumn("_p", F.lit(1))
    right = items.select(key).distinct().withColumn("_i", F.lit(1))
    both = left.join(right, key, "full")
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_i").isNull(), "extra")
    return both.select(key, state.alias("state")).filter(F.col("state").isNotNull())


def tag_contamination(rows: DataFrame, tags: DataFrame, key: str, tag: str = "is_clean") -> DataFrame:
    joined = rows.join(tags.select(key, tag), key, "left")
    return joined.withColumn(tag, F.coalesce(tag, F.lit("not labeled")))


def model_pairs(models: DataFrame, mode: str = "allpair", base: Sequence[str] = ()) -> DataFrame:
    """All unordered pairs, or every base model against every other one."""
    a, b = models.select(F.col("model").alias("model_a")), models.select(F.col("model").alias("model_b"))
    if mode == "allpair":
        return a.join(b, F.col("model_a") < F.col("model_b"))
    return a.filter(F.col("model_a").isin(list(base))).join(b, F.col("model_a") != F.col("model_b"))


def dedup_unordered_pairs(pairs: DataFrame, order: str) -> DataFrame:
    """First occurrence of {a, b}; pairs of a model with itself dropped."""
    rows = pairs.filter("model_a <> model_b")
    first = F.min_by(F.struct("model_a", "model_b", order), F.col(order)).alias("_r")
    keys = [F.least("model_a", "model_b").alias("_lo"), F.greatest("model_a", "model_b").alias("_hi")]
    return rows.groupBy(*keys).agg(first).select("_r.*")


def pair_predictions(preds: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Per item, the answers of the two models of each pair side by side.

    ``preds`` holds one row per model and key, so a key has as many rows as there are models.
    """
    a = preds.select(*keys, F.col("model").alias("model_a"), F.col("answer").alias("answer_a"))
    b = preds.select(*keys, F.col("model").alias("model_b"), F.col("answer").alias("answer_b"))
    return a.join(pairs.select("model_a", "model_b"), "model_a").join(b, [*keys, "model_b"])


def drop_identical_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.col("answer_a").eqNullSafe(F.col("answer_b")))


def match_baseline(preds: DataFrame, baseline: DataFrame, key: str = "gt") -> DataFrame:
    """Predictions next to the baseline's answer for the same ground truth.

    Skewed ground truths are spread by adaptive skew join, as the baseline is unique per key.
    """
    return preds.join(baseline.select(key, F.col("prediction").alias("baseline_prediction")), key)


def pending_work(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def bad_cases(scored: DataFrame, label_scores: DataFrame | None = None) -> DataFrame:
    """Rows whose answer is wrong; with label scores, the losses of the chosen and the gold label."""
    wrong = scored.filter(~F.col("answer").eqNullSafe(F.col("gold")))
    if label_scores is None:
        return wrong
    scores = label_scores.select("item_id", "label", "nll")
    mine = scores.withColumnsRenamed({"label": "answer", "nll": "pred_nll"})
    best = scores.withColumnsRenamed({"label": "gold", "nll": "gold_nll"})
    return wrong.join(mine, ["item_id", "answer"], "left").join(best, ["item_id", "gold"], "left")


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def fan_out_judges(pairs: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Every pair to every judge, as an explode of the short judge list."""
    return pairs.withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))


def meta_input(judgements: DataFrame, keys: Sequence[str], verdict: Column) -> DataFrame:
    """All judges' verdicts on one pair, as the meta judge sees them (one entry per judge)."""
    entry = F.struct("judge", verdict.alias("verdict"))
    return judgements.groupBy(*keys).agg(F.array_sort(F.collect_set(entry)).alias("verdicts"))
