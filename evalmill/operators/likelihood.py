"""Metrics over label scores and token losses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.ordering import running


def min_loss_choice(scores: DataFrame, keys=("item_id",), norm: str | None = None) -> DataFrame:
    """Label with the smallest loss (optionally minus the normalising prompt's); first label on ties."""
    loss = F.col("nll") - F.col(norm) if norm else F.col("nll")
    return scores.groupBy(*keys).agg(F.min_by("label", F.struct(loss, "label_pos")).alias("choice"))


def max_likelihood_choice(scores: DataFrame, keys=("item_id",), ll: str = "ll") -> DataFrame:
    return scores.groupBy(*keys).agg(F.max_by("label", F.struct(F.col(ll), -F.col("label_pos"))).alias("choice"))


def choice_probabilities(scores: DataFrame, keys=("item_id",), logp: str = "logp") -> DataFrame:
    """Softmax over the candidates of an item, and the position of the most likely one.

    An item has a handful of candidates, so its array is small.
    """
    listed = F.array_sort(F.collect_list(F.struct("label_pos", F.col(logp).alias("x"))))
    rows = scores.groupBy(*keys).agg(listed.alias("_l"), F.max(logp).alias("_m"))
    weights = F.transform("_l", lambda s: F.exp(s["x"] - F.col("_m")))
    rows = rows.withColumn("_w", weights).withColumn("_z", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    return rows.select(
        *keys,
        F.transform("_w", lambda x: x / F.col("_z")).alias("prediction"),
        F.get("_l", F.array_position(F.transform("_l", lambda s: s["x"]), F.col("_m")).cast("int") - 1)["label_pos"].alias("pred_label"),
    )


def loss_ranking_accuracy(scores: DataFrame, items: DataFrame, kind: str, gold: str = "gold") -> DataFrame:
    """Accuracy of the smallest-loss label per question type and in total."""
    chosen = min_loss_choice(scores).join(items.select("item_id", kind, gold), "item_id")
    right = F.avg(F.when(F.col("choice") == F.col(gold), 100.0).otherwise(0.0)).alias("accuracy")
    out = chosen.groupingSets([[F.col(kind)], []], kind).agg(right, F.grouping(kind).alias("_all"))
    return out.withColumn(kind, F.when(F.col("_all") == 1, "total").otherwise(F.col(kind))).drop("_all")


def bits_per_byte(scores: DataFrame, by=(), keys=("item_id",)) -> DataFrame:
    """Mean smallest bits per byte over items, and mean of the others' average; times 100. NaN values are left out."""
    bpb = F.nanvl((F.col("nll") * F.col("n_tokens") / F.nullif("n_bytes", F.lit(0.0))).cast("double"), F.lit(None).cast("double"))
    per = scores.groupBy(*by, *keys).agg(F.min(bpb).alias("lo"), F.sum(bpb).alias("s"), F.count(bpb).alias("n"))
    others = F.when(F.col("n") > 1, (F.col("s") - F.col("lo")) / (F.col("n") - 1))
    return per.groupBy(*by).agg((F.avg("lo") * 100).alias("correct_bpb"), (F.avg(others) * 100).alias("incorrect_bpb"))


def average_ppl(scores: DataFrame, by) -> DataFrame:
    """Plain mean, and mean weighted by tokens."""
    return scores.groupBy(*by).agg(
        F.avg("nll").alias("average_ppl"),
        (F.sum(F.col("nll") * F.col("n_tokens")) / F.sum("n_tokens")).alias("token_weighted_ppl"),
    )


def min_k_percent(losses: DataFrame, k: int, by=("seq_id",)) -> DataFrame:
    """Per sequence, minus the mean of the k percent largest token losses (at least one).

    Ranks come from range slots, so one very long sequence does not sit in one task.
    """
    ranked = running(losses, by, -F.col("loss"), F.col("pos"))
    sizes = losses.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.floor(F.col("_n") * k / 100), F.lit(1))
    top = ranked.join(sizes, list(by)).filter(F.col("rank") <= keep)
    return top.groupBy(*by).agg((-F.avg("loss")).alias("min_k"))


def bits_per_character(losses: DataFrame, documents: DataFrame, by=(), loss="loss", chars="n_chars") -> DataFrame:
    total = losses.groupBy(*by).agg(F.sum(loss).alias("_l"))
    size = documents.groupBy(*by).agg(F.sum(chars).alias("_c"))
    both = total.join(size, list(by)) if by else total.join(size, F.lit(True))
    return both.select(*by, (F.col("_l") / (F.col("_c") * math.log(2))).alias("bpc"))


def sliding_windows(losses: DataFrame, block: int, stride: int, seq="seq_id", pos="pos", loss="loss") -> DataFrame:
    """Scored loss per window over all sequences laid end to end.

    Window i covers [i*stride, i*stride+block) and scores only what no earlier
    window has scored, so a token's window follows from its global place.
    """
    placed = running(losses, [], F.col(seq), F.col(pos), rank="place").withColumn("place", F.col("place") - 1)
    windows = (losses.count() - block) // stride + 1
    window = F.when(F.col("place") < block, 0).otherwise(F.floor((F.col("place") - block) / stride) + 1).cast("bigint")
    scored = placed.withColumn("window", window).filter(F.col("window") < windows)
    return scored.groupBy("window").agg(F.count(F.lit(1)).alias("scored"), F.sum(loss).alias("loss"))


def monte_carlo_ll(draws: DataFrame, by=("item_id",)) -> DataFrame:
    """Minus the mean over draws of the summed masked-token loss over the mask ratio, per batch row; with standard error.

    Rows: (item, draw, batch, pos, ce, ratio).
    """
    per = draws.groupBy(*by, "draw").agg((F.sum(F.col("ce") / F.col("ratio")) / F.countDistinct("batch")).alias("_l"))
    return per.groupBy(*by).agg(
        (-F.avg("_l")).alias("ll"), (F.stddev_samp("_l") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("draws")
    )


def guided_log_probs(cond: DataFrame, uncond: DataFrame, scale: float, keys=("item_id", "pos"), token="token") -> DataFrame:
    """un + (scale + 1) (cond - un) per position and token, renormalised per position.

    A position holds at most the vocabulary, and its normaliser is an aggregate joined back.
    """
    both = cond.withColumnRenamed("logit", "_c").join(uncond.withColumnRenamed("logit", "_u"), [*keys, token])
    mixed = both.withColumn("_g", F.col("_u") + (scale + 1) * (F.col("_c") - F.col("_u")))
    top = mixed.groupBy(*keys).agg(F.max("_g").alias("_m"))
    shifted = mixed.join(top, list(keys))
    total = shifted.groupBy(*keys).agg(F.sum(F.exp(F.col("_g") - F.col("_m"))).alias("_z"))
    return shifted.join(total, list(keys)).select(*keys, token, (F.col("_g") - F.col("_m") - F.log("_z")).alias("logp"))


def split_gaps(scores: DataFrame, by, split="split", ppl="nll") -> DataFrame:
    """Mean perplexity of train, test and reference texts, and the differences that hint at leakage."""
    mean = lambda s: F.avg(F.when(F.col(split) == s, F.col(ppl)))
    out = scores.groupBy(*by).agg(mean("train").alias("train"), mean("test").alias("test"), mean("ref").alias("ref"))
    return out.withColumn("test_minus_train", F.col("test") - F.col("train")).withColumn(
        "test_minus_ref", F.col("test") - F.col("ref")
    )


def entropy_choice(losses: DataFrame, keys=("test_id",)) -> DataFrame:
    """Per test row, the demonstration subset with the largest negative label entropy.

    Rows: (test_id, subset_id, label, loss); p = softmax(-loss) over the few labels.
    """
    x = -F.col("loss")
    per = losses.groupBy(*keys, "subset_id").agg(F.collect_list(x).alias("_x"), F.max(x).alias("_m"))
    shifted = F.transform("_x", lambda v: v - F.col("_m"))
    zero = F.lit(0.0)
    per = per.withColumn("_d", shifted)
    z = F.aggregate("_d", zero, lambda a, v: a + F.exp(v))
    s = F.aggregate("_d", zero, lambda a, v: a + v * F.exp(v))
    per = per.withColumn("_z", z).withColumn("_s", s)
    per = per.withColumn("neg_entropy", F.col("_s") / F.col("_z") - F.log("_z"))
    best = F.max_by("subset_id", F.struct(F.round("neg_entropy", 12), -F.col("subset_id")))
    return per.groupBy(*keys).agg(best.alias("subset_id"), F.max("neg_entropy").alias("neg_entropy"))
