"""From tall results (model, dataset, metric, score) to group scores and tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.session import pin

# fixed values: metrics in order of preference, and metrics never shown
PREFERRED = [
    "score", "auc_score", "accuracy", "humaneval_pass@1", "rouge1", "avg_toxicity_score",
    "bleurt_diff", "matthews_correlation", "truth", "f1", "exact_match", "extract_rate",
]
HIDDEN = ["bp", "sys_len", "ref_len", "type"]


def tidy(raw: DataFrame, metrics: str = "metrics") -> DataFrame:
    """(model, dataset, metrics map<string,string>) to tall numeric rows with ``metric_rank``.

    Hidden and non-numeric metrics go; a result that holds ``error`` is
    skipped; preferred metrics rank first, the others by name.
    """
    rows = raw.filter(~F.map_contains_key(metrics, F.lit("error"))).select(
        "model", "dataset", F.explode(metrics).alias("metric", "_v")
    )
    rows = rows.withColumn("score", F.col("_v").try_cast("double"))
    rows = rows.filter(F.col("score").isNotNull() & ~F.col("metric").isin(HIDDEN)).drop("_v")
    place = F.array_position(F.array(*[F.lit(m) for m in PREFERRED]), F.col("metric"))
    # a result holds a handful of metrics, so the window groups are tiny
    w = Window.partitionBy("model", "dataset").orderBy(F.when(place > 0, place).otherwise(len(PREFERRED) + 1), "metric")
    return rows.withColumn("metric_rank", F.row_number().over(w))


def common_metrics(results: DataFrame, subsets: Sequence[str]) -> DataFrame:
    """Metrics that every subset reports."""
    rows = results.filter(F.col("dataset").isin(list(subsets)))
    counts = rows.groupBy("metric").agg(F.countDistinct("dataset").alias("n"))
    return counts.filter(F.col("n") == len(set(subsets))).select("metric")


def missing_subsets(results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(model, group, dataset) for which there is no result."""
    wanted = results.select("model").distinct().join(taxonomy.select("group", "dataset"), F.lit(True))
    return wanted.join(results.select("model", "dataset").distinct(), ["model", "dataset"], "left_anti")


def group_scores(results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Scores of groups of sets.

    ``taxonomy(group, dataset, metric, weight, how)`` with ``how`` one of
    naive_average, weighted_average, sum, standard_deviation, harmonic_mean.
    A group with no subset result is skipped, one with some missing becomes an
    ``error`` row with a null score.
    """
    sizes = taxonomy.groupBy("group").agg(F.count(F.lit(1)).alias("wanted"))
    stats = averages(results.join(taxonomy, ["dataset", "metric"]), ["model", "group", "how"])
    whole = F.col("present") == F.col("wanted")
    return stats.join(sizes, "group").select(
        "model",
        "group",
        F.when(whole, F.col("how")).otherwise("error").alias("metric"),
        F.when(whole, F.col("value")).alias("score"),
    )


def averages(found: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """``present`` and the ``value`` that ``how`` names, of score(s) and weight(s) per ``by``, which holds ``how``."""
    s, w = F.col("score"), F.col("weight")
    clamped = F.sum(1.0 / F.greatest(s, F.lit(1.0)))
    values = {
        "naive_average": F.avg(s),
        "weighted_average": F.sum(F.when(w != 0, s * w)) / F.sum(w),
        "sum": F.sum(s),
        "standard_deviation": F.stddev_pop(s),
        "harmonic_mean": F.when(F.min(s) <= 0, F.count(s) / clamped).otherwise(F.count(s) / F.sum(F.when(s > 0, 1.0 / s))),
    }
    stats = found.groupBy(*by).agg(F.count(F.lit(1)).alias("present"), *[v.alias(how) for how, v in values.items()], *more)
    value = F.lit(None).cast("double")
    for how in values:
        value = F.when(F.col("how") == how, F.col(how)).otherwise(value)
    return stats.withColumn("value", value).drop(*values)


def group_levels(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Groups of (group, member) edges by level; a level needs sets and groups of the levels before it."""
    needs: dict[str, set[str]] = {}
    for group, member in edges:
        needs.setdefault(group, set()).add(member)
    needs = {g: {m for m in members if m in needs} for g, members in needs.items()}
    out = []
    while needs:
        ready = sorted(g for g, left in needs.items() if not left)
        if not ready:
            raise ValueError(f"groups that contain each other: {sorted(needs)}")
        out.append(ready)
        needs = {g: left - set(ready) for g, left in needs.items() if g not in ready}
    return out


def nested_groups(results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Scores of groups of sets and of groups of groups, as (model, group, metric, score, metric_rank).

    ``results(model, dataset, metric, score, metric_rank)`` as from ``tidy``; ``taxonomy(group, member, metric, weight,
    how, name)``, of which ``metric``, ``weight`` and ``name`` may be null. Members are sets or other groups. Members
    without a metric give every metric they all have, and a default score over each one's first metric; members with
    one give the default only. The default metric has the group's ``name``, else ``how``, and comes last. A group none
    of whose members has a score is skipped; one with some missing is an ``error`` row, and missing to groups above it.

    The taxonomy is written by hand, so its edges are ordered on the driver; scores stay in Spark, one join a level.
    """
    listed = taxonomy.select("group", "member", F.col("metric").isNull().alias("plain")).distinct().collect()
    kinds: dict[str, set[bool]] = {}
    for r in listed:
        kinds.setdefault(r["group"], set()).add(r["plain"])
    mixed = sorted(g for g, k in kinds.items() if len(k) > 1)
    if mixed:
        raise ValueError(f"groups with and without metrics: {mixed}")
    columns = ["model", "dataset", "metric", "score", "metric_rank"]
    known = pin(results.select(*columns))
    parts = []
    for level in group_levels((r["group"], r["member"]) for r in listed):
        rows = pin(_group_level(known, taxonomy.filter(F.col("group").isin(level))))
        parts.append(rows)
        known = known.unionByName(rows.filter(F.col("score").isNotNull()).withColumnRenamed("group", "dataset").select(*columns))
    return reduce(DataFrame.unionByName, parts)


def _group_level(known: DataFrame, taxonomy: DataFrame) -> DataFrame:
    default = F.coalesce("name", "how")
    sizes = taxonomy.groupBy("group").agg(F.count(F.lit(1)).alias("wanted"))
    members = taxonomy.select("group", "member", F.col("metric").alias("asked"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "how", default.alias("default"))
    found = members.join(known, F.col("member") == F.col("dataset")).filter(F.col("asked").isNull() | (F.col("asked") == F.col("metric")))
    first = found.filter(F.col("asked").isNotNull() | (F.col("metric_rank") == 1)).withColumn("metric", F.col("default")).withColumn("last", F.lit(True))
    shared = found.filter(F.col("asked").isNull() & (F.col("metric") != F.col("default"))).withColumn("last", F.lit(False))
    by = ["model", "group", "metric", "how", "last"]
    scored = averages(first.unionByName(shared), by, F.min("metric_rank").alias("_rank")).join(sizes, "group")
    whole = F.col("present") == F.col("wanted")
    # a metric that some member lacks is no metric of the group; a default that some member lacks is an error
    scored = scored.filter(whole | F.col("last"))
    place = Window.partitionBy("model", "group").orderBy("last", "_rank", "metric")
    return scored.select(
        "model", "group", F.when(whole, F.col("metric")).otherwise("error").alias("metric"), F.when(whole, F.col("value")).alias("score"),
        F.row_number().over(place).alias("metric_rank"),
    )


def run_modes(runs: DataFrame) -> DataFrame:
    """(dataset, mode) from (dataset, inferencer): how a set was run follows from the name of what ran it."""
    name = F.coalesce("inferencer", F.lit(""))
    mode = F.when(F.contains(name, F.lit("GenInferencer")), "gen").when(F.contains(name, F.lit("PPLInferencer")), "ppl")
    return runs.select("dataset", mode.when(F.contains(name, F.lit("LLInferencer")), "ll").otherwise("unknown").alias("mode"))


def group_modes(modes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(dataset, mode) of sets and groups: a group has its members' mode, ``mixed`` if they differ, unknown ones included."""
    known = modes.select("dataset", "mode")
    edges = taxonomy.select("group", "member").distinct()
    for level in group_levels((r["group"], r["member"]) for r in edges.collect()):
        members = edges.filter(F.col("group").isin(level)).join(known, F.col("member") == F.col("dataset"), "left")
        kinds = F.collect_set(F.coalesce("mode", F.lit("unknown")))
        rows = members.groupBy("group").agg(F.when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, F.lit(0))).alias("mode"))
        known = known.unionByName(rows.withColumnRenamed("group", "dataset"))
    return known


def pivot_models(results: DataFrame, models: Sequence[str], digits: int = 2, settings: DataFrame | None = None) -> DataFrame:
    """One row per (dataset, metric), one text column per model, ``-`` where missing.

    ``settings(dataset, version, mode)`` with one row per set adds the prompt version and how the set was run.
    """
    cell = F.format_string(f"%.{digits}f", F.round("score", digits))
    wide = results.withColumn("_c", cell).groupBy("dataset", "metric").pivot("model", list(models)).agg(F.first("_c"))
    cells = [F.coalesce(F.col(m), F.lit("-")).alias(m) for m in models]
    if settings is None:
        return wide.select("dataset", "metric", *cells)
    known = wide.join(settings.select("dataset", F.col("version").alias("_v"), F.col("mode").alias("_m")), "dataset", "left")
    version, mode = (F.coalesce(F.col(c), F.lit("-")).alias(name) for c, name in (("_v", "version"), ("_m", "mode")))
    return known.select("dataset", version, "metric", mode, *cells)


def two_level_table(results: DataFrame, models: Sequence[str], metrics: Sequence[str], settings: DataFrame | None = None, datasets: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """A text column per model and metric under two header lines: models above, metrics below.

    Columns are named c0, c1, ... and ``line`` orders them: 0 and 1 are the headers (a model's name stands over its
    first metric, ``-`` over the others), then one line per set, in the order of ``datasets`` or by name. Sets without
    any result have ``-`` everywhere.
    """
    shown = F.format_string(f"%.{digits}f", F.round("score", digits))
    cells = [F.max(F.when((F.col("model") == m) & (F.col("metric") == k), shown)) for m in models for k in metrics]
    wide = results.groupBy("dataset").agg(*[F.coalesce(c, F.lit("-")).alias(f"c{i + 3}") for i, c in enumerate(cells)])
    if settings is not None:
        wide = wide.join(settings.select("dataset", F.col("version").alias("_v"), F.col("mode").alias("_m")), "dataset", "left")
    else:
        wide = wide.withColumn("_v", F.lit(None).cast("string")).withColumn("_m", F.lit(None).cast("string"))
    names = [f"c{i + 3}" for i in range(len(cells))]
    body = wide.select(F.col("dataset").alias("c0"), F.coalesce("_v", F.lit("-")).alias("c1"), F.coalesce("_m", F.lit("-")).alias("c2"), *names)
    spark = results.sparkSession
    if datasets is not None:
        order = spark.createDataFrame([(i + 2, d) for i, d in enumerate(datasets)], "line int, c0 string")
        body = order.join(body, "c0", "left").fillna("-", ["c1", "c2", *names])
    else:
        # a board has a line per set: few enough to be numbered together
        body = body.withColumn("line", F.row_number().over(Window.orderBy("c0")) + 1)
    over = [m if i == 0 else "-" for m in models for i in range(len(metrics))]
    heads = [(0, "dataset", "version", "mode", *over), (1, "-", "-", "-", *(list(metrics) * len(models)))]
    columns = ["line", "c0", "c1", "c2", *names]
    top = spark.createDataFrame(heads, ", ".join(["line int", *[f"{c} string" for c in columns[1:]]]))
    return top.unionByName(body.select(*columns))


def compression_table(results: DataFrame, datasets: Sequence[str], digits: int = 4) -> DataFrame:
    """One row per model: a column per set and their average, best (smallest) first."""
    wide = results.groupBy("model").pivot("dataset", list(datasets)).agg(F.round(F.first("score"), digits))
    total = sum((F.col(d) for d in datasets[1:]), F.col(datasets[0]))
    return wide.withColumn("average", F.round(total / len(datasets), digits)).orderBy("average", "model")


def unpivot_scores(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide score columns back to (dataset, score) rows."""
    return wide.unpivot(list(ids), list(columns), "dataset", "score")


def profile_tables(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of the results per named profile(profile, dataset); empty profiles vanish in the join."""
    return results.join(profiles, "dataset").select("profile", "dataset", "model", "metric", "score")


def section_averages(results: DataFrame, sections: DataFrame) -> DataFrame:
    """Mean per section(section, dataset) and model."""
    return results.join(sections, "dataset").groupBy("section", "model").agg(F.avg("score").alias("score"))


def best_marked(results: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mark the best model of each (dataset, metric); within ``eps`` all are best."""
    top = results.groupBy("dataset", "metric").agg(F.max("score").alias("_top"))
    rows = results.join(top, ["dataset", "metric"])
    return rows.withColumn("best", F.col("score") > F.col("_top") - eps).drop("_top")


def win_count(results: DataFrame, eps: float = 1e-8) -> DataFrame:
    return best_marked(results, eps).groupBy("model").agg(F.count_if("best").alias("wins"))


def outer_merge(results: DataFrame, datasets: Sequence[str], complete: bool = True) -> DataFrame:
    """One row per model with a column per set; incomplete rows dropped if asked."""
    wide = results.groupBy("model").pivot("dataset", list(datasets)).agg(F.first("score"))
    return wide.dropna() if complete else wide


def length_summary(predictions: DataFrame, ratings: DataFrame, tokens: Column) -> DataFrame:
    """Mean answer length next to the ratings."""
    means = predictions.groupBy("model").agg(F.avg(tokens).alias("avg_tokens"))
    return ratings.join(means, "model", "left")
