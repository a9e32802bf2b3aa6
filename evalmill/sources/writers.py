"""Sinks: result folders, leaderboards in three formats, and the shared result store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per (model, dataset); rebalancing splits a folder that is much larger than the others."""
    df.hint("rebalance", "model", "dataset").write.mode("overwrite").partitionBy("model", "dataset").format(fmt).save(path)


def item_details(rows: DataFrame, judged: str | None = None) -> DataFrame:
    """(model, dataset, item_id, detail): what an item was asked, what came back and whether it is right.

    ``rows(model, dataset, item_id, prompt, prediction, answer, gold[, labels])``. Items with ``labels`` (label to
    loss) were answered by likelihood, the others by text. Right is ``answer = gold``, or the column ``judged``.
    An answer that is null was not found in the text.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    labels = F.col("labels") if "labels" in rows.columns else F.lit(None).cast("map<string,double>")
    right = F.col(judged) if judged else F.coalesce(F.col("answer").cast("string") == F.col("gold").cast("string"), F.lit(False))
    detail = F.struct(
        F.when(labels.isNull(), "GEN").otherwise("PPL").alias("type"),
        text("prompt"), F.col("prediction").cast("string").alias("origin_prediction"), labels.alias("labels"),
        F.col("answer").cast("string").alias("predictions"), F.col("gold").cast("string").alias("references"), right.alias("correct"),
    )
    return rows.select("model", "dataset", "item_id", detail.alias("detail"))


def write_details(details: DataFrame, path: str) -> None:
    """Details beside the metrics: a folder per (model, dataset), sorted by item inside its files.

    A large folder is split over several files by the rebalance hint, so no task holds a whole set.
    """
    rows = details.hint("rebalance", "model", "dataset").sortWithinPartitions("model", "dataset", "item_id")
    rows.write.mode("overwrite").partitionBy("model", "dataset").parquet(path)


def extraction_rates(details: DataFrame) -> DataFrame:
    """Share of items per (model, dataset) from whose text an answer was found, and of right ones, in percent."""
    found = F.coalesce(F.col("detail.predictions") != "", F.lit(False))
    hundred = lambda flag: F.avg(F.when(flag, 100.0).otherwise(0.0))
    return details.groupBy("model", "dataset").agg(hundred(found).alias("extraction_rate"), hundred(F.col("detail.correct")).alias("accuracy"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """The table's rows as Markdown lines, keyed so that header and rule come first."""
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "|".join(["---"] * len(df.columns)) + "|"
    first = df.columns[0]
    body = df.select(
        F.lit(2).alias("part"),
        F.col(first).cast("string").alias("key"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |")).alias("value"),
    )
    top = df.sparkSession.createDataFrame([(0, "", head), (1, "", rule)], "part int, key string, value string")
    return top.unionByName(body)


def text_lines(df: DataFrame) -> DataFrame:
    """A header and the table's rows as lines; every column is as wide as its longest cell."""
    shown = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    longest = shown.agg(*[F.max(F.char_length(c)).alias(c) for c in shown.columns]).first()
    widths = [max(len(name), longest[c] or 0) for name, c in zip(df.columns, shown.columns)]
    head = " ".join(name.ljust(w) for name, w in zip(df.columns, widths)).rstrip()
    body = shown.select(F.lit(1).alias("part"), F.rtrim(F.concat_ws(" ", *[F.rpad(c, w, " ") for c, w in zip(shown.columns, widths)])).alias("value"))
    return df.sparkSession.createDataFrame([(0, head)], "part int, value string").unionByName(body)


def write_leaderboard(df: DataFrame, path: str, fmt: str) -> None:
    """A leaderboard has few rows (sets x metrics), so it is written as one file."""
    if fmt == "csv":
        plain = df.select(*[F.replace(F.col(f"`{c}`").cast("string"), F.lit(","), F.lit(" ")).alias(c) for c in df.columns])
        plain.coalesce(1).write.mode("overwrite").csv(path, header=True)
    elif fmt == "markdown":
        markdown_lines(df).coalesce(1).sortWithinPartitions("part", "key").select("value").write.mode("overwrite").text(path)
    elif fmt == "text":
        text_lines(df).coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


class ResultStore:
    """Shared results as parquet partitioned by (dataset, model)."""

    keys = ["dataset", "model"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def lookup(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def publish(self, results: DataFrame, overwrite: bool = False) -> None:
        """Add results; a stored (dataset, model) is kept, or replaced as a whole partition."""
        held = self.lookup()
        rows = results
        if overwrite:
            rows.hint("rebalance", *self.keys).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*self.keys).parquet(self.path)
            return
        if held is not None:
            rows = rows.join(held.select(*self.keys).distinct(), self.keys, "left_anti")
        rows.hint("rebalance", *self.keys).write.mode("append").partitionBy(*self.keys).parquet(self.path)
