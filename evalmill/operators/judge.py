"""Summaries of judge verdicts. Every one is a per-row score and one or a few small aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.functions.text import strip
from evalmill.operators.ordering import dealt


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def grade_summary(df, by, grade="grade"):
    """A right, B wrong, anything else not attempted."""
    n, right, wrong = F.count(F.lit(1)), F.count_if(F.col(grade) == "A"), F.count_if(F.col(grade) == "B")
    c = df.groupBy(*by).agg(n.alias("n"), right.alias("correct_count"), wrong.alias("incorrect_count"))
    share_right = F.col("correct_count") / F.col("n")
    given = _safe(F.col("correct_count"), F.col("correct_count") + F.col("incorrect_count"))
    return c.select(
        *by,
        (share_right * 100).alias("accuracy"),
        (given * 100).alias("accuracy_given_attempted"),
        _safe(2 * given * share_right, given + share_right).alias("f1"),
        ((F.col("correct_count") + F.col("incorrect_count")) / F.col("n") * 100).alias("attempted_ratio"),
        "correct_count",
        "incorrect_count",
        (F.col("n") - F.col("correct_count") - F.col("incorrect_count")).alias("not_attempted_count"),
    )


def judged_correct(text: Column) -> Column:
    """Judge text says A or starts with CORRECT."""
    cleaned = F.upper(strip(text))
    return (cleaned == "A") | cleaned.startswith("CORRECT")


def cascade(ruled: DataFrame, judged: DataFrame, by, keys: Sequence[str], parallel: bool = False):
    """Rule first; the judge decides the failures (or everything, then either).

    ``ruled(keys, right)``, ``judged(keys, judge_text)``.
    """
    asked = ruled if parallel else ruled.filter(~F.col("right"))
    verdicts = asked.select(*keys).join(judged, list(keys)).select(*keys, judged_correct(F.col("judge_text")).alias("_j"))
    rows = ruled.join(verdicts, list(keys), "left")
    final = F.col("right") | F.coalesce("_j", F.lit(False))
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return rows.groupBy(*by).agg(
        pct(F.col("right")).alias("initial_accuracy"),
        (F.count_if("_j") / F.nullif(F.count("_j"), F.lit(0)) * 100).alias("judge_accuracy"),
        F.count("_j").alias("judged"),
        pct(final).alias("final_accuracy"),
    )


def rubric_scores(df, by, key="item_id", points="points", met="criteria_met"):
    """Per response: points of met criteria over all positive points, null without positive points."""
    rows = df.groupBy(*by, key).agg(
        F.sum(F.when(F.col(met), F.col(points)).otherwise(0.0)).alias("_a"),
        F.sum(F.when(F.col(points) > 0, F.col(points)).otherwise(0.0)).alias("_t"),
    )
    return rows.select(*by, key, F.when(F.col("_t") > 0, F.col("_a") / F.col("_t")).alias("score"))


def rubric_summary(scores, by, score="score"):
    """Mean clipped to [0, 1], and the number of scored responses."""
    clipped = F.greatest(F.least(F.avg(score), F.lit(1.0)), F.lit(0.0))
    return scores.groupBy(*by).agg(clipped.alias("score"), F.count(score).alias("n_samples"))


def bootstrap_means(df, by, id_col: str, value: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Resampled means per round: every row gets a Poisson(1) weight per round out of a hash of its id.

    Each batch of rows becomes ``rounds`` partial sums per slice before
    anything is shuffled, so the work is rows x rounds but the shuffle is only
    slices x rounds per batch.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h")
    )
    # as many counts as a draw of 53 bits can tell apart
    cuts = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(20)])

    def partial(batches):
        step = np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start : start + 2000]
                with np.errstate(over="ignore"):
                    z = part["_h"].to_numpy().astype(np.uint64)[:, None] + step[None, :]
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    z = z ^ (z >> np.uint64(31))
                weight = np.searchsorted(cuts, (z >> np.uint64(11)) / float(1 << 53), side="right")
                values = part["_v"].to_numpy()
                groups = part.groupby(by, sort=False).indices if by else {(): np.arange(len(part))}
                for key, where in groups.items():
                    w = weight[where]
                    out = pd.DataFrame(
                        {"round": np.arange(rounds), "_w": w.sum(axis=0).astype(float), "_s": (w * values[where, None]).sum(axis=0)}
                    )
                    for name, part_key in zip(by, key if isinstance(key, tuple) else (key,)):
                        out[name] = part_key
                    yield out[[*by, "round", "_w", "_s"]]

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "round bigint, _w double, _s double"])
    sums = rows.mapInPandas(partial, schema).groupBy(*by, "round").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    return sums.select(*by, "round", (F.col("_s") / F.nullif("_w", F.lit(0.0))).alias("mean"))


def bootstrap_std(df, by, id_col, value, rounds: int = 1000, seed: int = 0) -> DataFrame:
    clipped = F.greatest(F.least(F.col("mean"), F.lit(1.0)), F.lit(0.0))
    return bootstrap_means(df, by, id_col, value, rounds, seed).groupBy(*by).agg(F.stddev_pop(clipped).alias("bootstrap_std"))


def weighted_checklist(df, weights: DataFrame, by, key="item_id", kind="subcategory", scores="scores"):
    """Weighted sum of the checklist scores, rescaled by (x - 75) * 4; mean over parsed answers.

    ``weights(subcategory, pos, weight)`` is a small fixed table.
    """
    rows = df.filter(F.col(scores).isNotNull()).select(*by, key, kind, scores)
    rows = dealt(rows, [*by, key]).select(*by, key, kind, F.posexplode(scores).alias("pos", "_s"))
    dots = rows.join(F.broadcast(weights), [kind, "pos"]).groupBy(*by, key).agg(F.sum(F.col("_s") * F.col("weight")).alias("_x"))
    return dots.groupBy(*by).agg(F.avg((F.col("_x") - 75) * 4).alias("overall_score"))


def capability_means(df, by, capability="capability", score="score", digits: int = 2):
    """Mean per capability and in total."""
    out = df.groupingSets([[*map(F.col, by), F.col(capability)], [*map(F.col, by)]], *by, capability).agg(
        F.round(F.avg(score), digits).alias("score"), F.grouping(capability).alias("_all")
    )
    return out.withColumn(capability, F.when(F.col("_all") == 1, "total").otherwise(F.col(capability))).drop("_all")


def mean_of_means(df, taxonomy: Mapping[str, Sequence[str]], by, capability="capability", score="score"):
    """Capability means, category = mean of its capabilities, total = mean of the categories."""
    parent = F.lit(None).cast("string")
    for category, members in taxonomy.items():
        parent = F.when(F.col(capability).isin(list(members)), category).otherwise(parent)
    low = df.groupBy(*by, capability).agg(F.avg(score).alias("score"))
    mid = low.withColumn("_c", parent).filter("_c is not null").groupBy(*by, "_c").agg(F.avg("score").alias("score"))
    top = mid.groupBy(*by).agg(F.avg("score").alias("score"))
    return (
        low.select(*by, F.lit("capability").alias("level"), F.col(capability).alias("name"), "score")
        .unionByName(mid.select(*by, F.lit("category").alias("level"), F.col("_c").alias("name"), "score"))
        .unionByName(top.select(*by, F.lit("total").alias("level"), F.lit("total").alias("name"), "score"))
    )


def dimension_means(df, by, ratings="ratings"):
    """Mean rating per dimension of a map<string,double>."""
    rows = df.select(*by, F.explode(ratings).alias("dimension", "_r"))
    return rows.groupBy(*by, "dimension").agg(F.avg("_r").alias("score"))


def worst_turn(df, by, task="task", dialogue="multi_id", score="score"):
    """Smallest turn score per dialogue, mean per task, mean of the tasks."""
    low = df.groupBy(*by, task, dialogue).agg(F.min(score).alias("_s"))
    tasks = low.groupBy(*by, task).agg(F.avg("_s").alias("score"))
    total = tasks.groupBy(*by).agg(F.avg("score").alias("score"))
    return tasks.unionByName(total.withColumn(task, F.lit("average")))


def surviving_rounds(df, taxonomy, by, capability="capability", language="language", rounds="rounds", flagged="flagged"):
    """(rounds - flagged) / rounds per capability and language, rolled up as mean of means."""
    rows = df.withColumn("score", (F.col(rounds) - F.col(flagged)) / F.col(rounds)).withColumn(
        "capability", F.concat_ws("_", F.col(capability), F.col(language))
    )
    return mean_of_means(rows, taxonomy, by)


def satisfaction_by_level(df, by, levels: int = 5, level="level", hard="hard", soft="soft"):
    """Hard and soft satisfaction per level and averaged.

    Each level is owed rows/levels answers; invalid rows (hard < 0) leave that level's count.
    """
    n = F.floor(F.count(F.lit(1)) / levels)
    cols = []
    for i in range(1, levels + 1):
        at = F.col(level) == i
        due = n - F.count_if(at & (F.col(hard) < 0))
        for name, c in (("HSR", hard), ("SSR", soft)):
            total = F.coalesce(F.sum(F.when(at & (F.col(hard) >= 0), F.col(c))), F.lit(0.0))
            cols.append(F.when(due != 0, total / due).otherwise(0.0).alias(f"{name}_L{i}"))
    out = df.groupBy(*by).agg(*cols)
    for name in ("HSR", "SSR"):
        parts = [F.col(f"{name}_L{i}") for i in range(1, levels + 1)]
        out = out.withColumn(f"{name}_AVG", sum(parts[1:], parts[0]) / levels)
    return out


def win_rates(df, base: str, by, capability="capability", verdict="verdict", half_add: bool = False):
    """Wins of the base and of the other model in percent, per capability and in total."""
    base_first = F.col("model_a") == base
    draw = 0.5 if half_add else 0.0
    first = F.when(F.col(verdict) == "A", 1.0).when(F.col(verdict) == "B", 0.0).otherwise(draw)
    second = F.when(F.col(verdict) == "B", 1.0).when(F.col(verdict) == "A", 0.0).otherwise(draw)
    rows = df.filter(F.col(verdict).isNotNull()).withColumn("_base", F.when(base_first, first).otherwise(second))
    rows = rows.withColumn("_other", F.when(base_first, second).otherwise(first))
    out = rows.groupingSets([[*map(F.col, by), F.col(capability)], [*map(F.col, by)]], *by, capability).agg(
        F.round(F.avg("_base") * 100, 2).alias("base_win"), F.round(F.avg("_other") * 100, 2).alias("other_win"),
        F.grouping(capability).alias("_all"),
    )
    return out.withColumn(capability, F.when(F.col("_all") == 1, "total").otherwise(F.col(capability))).drop("_all")


def win_both_ways(df, model_1: str, by, capability="capability", verdict="verdict"):
    """``win_both`` counts a draw for both sides, ``half_draw`` only wins; per capability and its prefix.

    A side without any win scores 0 in both.
    """
    winner = F.when(F.col(verdict) == "A", F.col("model_a")).when(F.col(verdict) == "B", F.col("model_b"))
    one = F.coalesce(winner == model_1, F.lit(False))
    two = F.coalesce(winner != model_1, F.lit(False))
    names = F.array_distinct(F.array(F.col(capability), F.substring_index(capability, "-", 1)))
    rows = df.filter(F.col(verdict).isNotNull()).select(
        *by, F.explode(names).alias(capability), one.alias("_1"), two.alias("_2"), winner.isNull().alias("_d")
    )
    c = rows.groupBy(*by, capability).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_1").alias("w1"), F.count_if("_2").alias("w2"), F.count_if("_d").alias("d")
    )
    pct = lambda w, extra: F.when(F.col(w) > 0, F.round((F.col(w) + extra) / F.col("n") * 100, 2)).otherwise(0.0)
    return c.select(
        *by, capability, pct("w1", F.col("d")).alias("win_both_1"), pct("w2", F.col("d")).alias("win_both_2"),
        pct("w1", F.lit(0)).alias("half_draw_1"), pct("w2", F.lit(0)).alias("half_draw_2"),
    )


# fixed values: margin of each verdict from the first answer's side
MARGINS = {
    "A>>B": 1.0, "B<<A": 1.0, "A>B": 0.5, "B<A": 0.5, "A=B": 0.0, "B=A": 0.0,
    "A<B": -0.5, "B>A": -0.5, "A<<B": -1.0, "B>>A": -1.0,
    "A++": 1.0, "A+": 0.5, "B+": -0.5, "B++": -1.0,
}


def margin(verdict: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MARGINS.items() for x in kv])
    return F.try_element_at(table, verdict)


def margin_scores(df, base: str, by, category="category", difficulty="difficulty", verdict="verdict"):
    """Margin of the compared model over the base, overall and per category x difficulty, times 100."""
    sign = F.when(F.col("model_a") == base, -1).when(F.col("model_b") == base, 1)
    rows = df.withColumn("_m", margin(F.col(verdict)) * sign).filter(F.col("_m").isNotNull())
    base_keys = [F.col(c) for c in by]
    out = rows.groupingSets([[*base_keys, F.col(category), F.col(difficulty)], base_keys], *by, category, difficulty).agg(
        F.round(F.avg("_m") * 100, 3).alias("score"), F.grouping(category).alias("_all")
    )
    name = F.when(F.col("_all") == 1, "Average_score").otherwise(F.concat_ws("_", category, difficulty))
    return out.select(*by, name.alias("metric"), "score")


def tag_margins(df, groups: Mapping[str, str], base_models: Sequence[str], by, tags="tags", verdict="verdict"):
    """Margin of the compared model per tag group (once per tag), and the mean of the groups."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    sign = F.when(F.col("model_a").isin(list(base_models)), -1).otherwise(1)
    rows = df.withColumn("_m", margin(F.col(verdict)) * sign).filter(F.col("_m").isNotNull())
    rows = rows.select(*by, "_m", F.explode(tags).alias("_t")).withColumn("group", F.try_element_at(table, F.col("_t")))
    per = rows.filter("`group` is not null").groupBy(*by, "group").agg(F.round(F.avg("_m") * 100, 2).alias("score"))
    return per.unionByName(per.groupBy(*by).agg(F.avg("score").alias("score")).withColumn("group", F.lit("average")))


def swapped_double_score(df, by, verdict="verdict", swapped="swapped"):
    """Win 1, tie 0.5 over both orders; verdicts that failed do not count."""
    mine = F.when(F.col(swapped), "B").otherwise("A")
    ok = F.col(verdict).isin("A", "B", "tie")
    points = F.when(F.col(verdict) == mine, 1.0).when(F.col(verdict) == "tie", 0.5).otherwise(0.0)
    return df.groupBy(*by).agg((F.sum(F.when(ok, points)) / F.count_if(ok) * 100).alias("score"))


def position_bias(df, by, question: Sequence[str], order: str, verdict="verdict", banned: Sequence[str] = ("C",)):
    """Later judgements of a question that repeat the letter of its first one (banned letters aside)."""
    first = df.groupBy(*by, *question).agg(F.min_by(verdict, order).alias("_f"), F.min(order).alias("_o"))
    rows = df.join(first, [*by, *question])
    same = (F.col(order) > F.col("_o")) & (F.col(verdict) == F.col("_f")) & ~F.col(verdict).isin(list(banned))
    return rows.groupBy(*by).agg(F.count_if(same).alias("position_bias"))


def judge_accuracy(df, by, text="judge_text", gold="gold"):
    """Letter after ``"Choice": "Model `` against the gold winner."""
    letter = F.substr(F.substring_index(F.col(text), '"Choice": "Model ', -1), F.lit(1), F.lit(1))
    right = F.contains(F.col(text), F.lit('"Choice": "Model ')) & (letter == F.col(gold))
    return df.groupBy(*by).agg(F.avg(F.when(right, 100.0).otherwise(0.0)).alias("accuracy"))


def judge_rank_divergence(df, reference: DataFrame, by, text="judge_text", gold="gold", skip: Sequence[str] = ()):
    """How far the judge's model ranking is from the reference scores(model, ref_score), with its accuracy.

    Ranks are over one row per model.
    """
    rows = df.withColumn("_c", E.verdict("winner")(F.col(text))).filter("_c is not null")
    accuracy = rows.groupBy(*by).agg(F.avg(F.when(F.col("_c") == F.col(gold), 100.0).otherwise(0.0)).alias("accuracy"))
    winner = F.when(F.col("_c") == "A", F.col("model_a")).otherwise(F.col("model_b"))
    wins = rows.select(*by, winner.alias("model")).filter(~F.col("model").isin(list(skip))).groupBy(*by, "model").agg(F.count(F.lit(1)).alias("_s"))
    place = lambda keys, score: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "model"))
    ranked = wins.withColumn("_r", place(list(by), "_s"))
    known = reference.withColumn("_one", F.lit(1)).withColumn("_r2", place(["_one"], "ref_score")).drop("_one")
    both = ranked.join(known, "model").withColumn("_dr", F.abs(F.col("_r") - F.col("_r2"))).withColumn(
        "_ds", F.abs(F.col("_s") - F.col("ref_score"))
    )
    c = both.groupBy(*by).agg(
        F.sum("_dr").alias("rank_diff"), F.sum("_ds").alias("score_diff"), F.max("_ds").alias("_max"), F.count(F.lit(1)).alias("_m")
    )
    part = F.col("rank_diff") / (F.col("_m") - 1) + F.col("score_diff") / F.col("_max")
    out = c.join(accuracy, list(by)).withColumn("normalized_diff", part / F.col("_m") * 100)
    return out.select(*by, "accuracy", "rank_diff", "score_diff", "normalized_diff").withColumn(
        "final_score", (F.col("accuracy") - F.col("normalized_diff") + 100) / 2
    )


def listwise_rank_sum(df, models: Sequence[str], by, order="order"):
    """Each number of the judge's list is added to the model at its place."""
    names = F.array(*[F.lit(m) for m in models])
    rows = df.select(*by, F.posexplode(F.regexp_extract_all(F.col(order), F.lit(r"\d+"), F.lit(0))).alias("_p", "_n"))
    rows = rows.withColumn("model", F.get(names, F.col("_p"))).filter("model is not null")
    return rows.groupBy(*by, "model").agg(F.sum(F.col("_n").cast("bigint")).alias("rank_sum"))


def battles_from_verdicts(df, text="verdict_text"):
    """Arena verdicts to winner and weight (3 for a clear win); what does not parse is dropped."""
    verdict = E.verdict("arena")(F.col(text))
    m = margin(verdict)
    rows = df.withColumn("_m", m).filter(F.col("_m").isNotNull())
    winner = F.when(F.col("_m") > 0, "model_a").when(F.col("_m") < 0, "model_b").otherwise("tie")
    return rows.withColumn("winner", winner).withColumn("weight", F.when(F.abs("_m") == 1, 3).otherwise(1)).drop("_m")


def judge_agreement(df, by, dataset="dataset", judge="judge_score", meta="meta_score", model="test_model", swap="swap"):
    """Per set: accuracy against the meta judge, and correlation over models of the summed signed verdicts."""
    rows = df.filter(F.col(meta).isNotNull()).withColumn("_sign", F.when(F.col(swap), -1).otherwise(1))
    per = rows.groupBy(*by, dataset, model).agg(
        F.count_if(F.col(judge) == F.col(meta)).alias("_ok"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col(meta) * F.col("_sign")).cast("double").alias("_meta"),
        F.coalesce(F.sum(F.col(judge) * F.col("_sign")), F.lit(0)).cast("double").alias("_self"),
    )
    return per.groupBy(*by, dataset).agg(
        F.round(F.sum("_ok") / F.sum("_n"), 3).alias("accuracy"), F.round(F.corr("_meta", "_self"), 3).alias("corr")
    )


def overall_agreement(df, by, judge="judge_score", meta="meta_score"):
    """Accuracy against the meta judge over the rows of all sets, next to the number of them."""
    rows = df.filter(F.col(meta).isNotNull())
    right = F.coalesce(F.count_if(F.col(judge) == F.col(meta)), F.lit(0))
    return rows.groupBy(*by).agg(F.round(right / F.count(F.lit(1)), 3).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def average_agreement(agreement, by):
    return agreement.groupBy(*by).agg(F.round(F.avg("corr"), 3).alias("avg_corr"))
