"""Incremental scoring of prediction files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def prediction_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Prediction parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def scored_stream(stream: DataFrame, items: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Repeated rows dropped while their event time is within ``delay``, then joined to the static items."""
    unique = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    rows = unique.join(items, "item_id")
    return rows.withColumn("right", (F.col("answer") == F.col("gold")).cast("int"))


def running_accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Right and total counts per slice (update mode); the state is one row per slice."""
    return scored.groupBy(*by).agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("total"))


def windowed_accuracy(scored: DataFrame, by: list[str], ts: str, width: str) -> DataFrame:
    """Counts per tumbling event-time window, final once the watermark has passed it."""
    out = scored.groupBy(F.window(ts, width).alias("w"), *by).agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "right", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, writing parquet (append) with exactly-once files."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def run_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode counts: each batch's changed slices are stored in a folder of their own.

    A batch that is run again after a failure overwrites its folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Newest counts per slice out of the batch folders."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct("right", "total"), "batch")
    return rows.groupBy(*by).agg(newest.alias("_c")).select(*by, "_c.*")
