"""Readers of question sets, predictions and judgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = r"\x{feff}"


def read_items(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """JSON lines or CSV whose columns are found by their header names; a byte-order mark at the start does no harm.

    A line that is no JSON, and a CSV without a wanted column, raise.
    """
    if fmt == "jsonl":
        wanted = StructType.fromDDL(schema)
        lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"))
        return lines.filter("value <> ''").select(F.from_json("value", wanted, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    if fmt == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        names = {c.lstrip("\ufeff"): c for c in rows.columns}
        return rows.select(*[F.col(f"`{names.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    raise ValueError(f"unknown format {fmt}: use jsonl or csv")


SUBJECT_SCHEMA = "input string, A string, B string, C string, D string, target string"


def read_subject_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``<subject>_<split>.csv`` files without header, six columns each; a row of other width raises."""
    rows = spark.read.csv(
        f"{folder}/*_{split}.csv", schema=SUBJECT_SCHEMA, escape='"', mode="FAILFAST", multiLine=True
    )
    # a subject may be a file or a folder of part files
    name = F.regexp_extract("_metadata.file_path", rf"([^/=]+)_{split}\.csv(?:/|$)", 1)
    return rows.select("*", F.url_decode(name).alias("subject"), F.lit(split).alias("split"))


NESTED_QA = """data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,
is_impossible:boolean,answers:array<struct<text:string>>,plausible_answers:array<struct<text:string>>>>>>>>"""


def read_nested_qa(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Articles, paragraphs and questions flattened; unanswerable rows also accept a fixed phrase."""
    raw = spark.read.json(path, schema=NESTED_QA, multiLine=whole_file)
    articles = raw.select(F.explode("data").alias("article"))
    paragraphs = articles.select(F.explode("article.paragraphs").alias("p"))
    rows = paragraphs.select("p.context", F.explode("p.qas").alias("qa"))
    given = F.array_distinct(F.col("qa.answers.text"))
    plausible = F.array_distinct(F.coalesce(F.col("qa.plausible_answers.text"), F.array().cast("array<string>")))
    impossible = F.coalesce("qa.is_impossible", F.lit(False))
    answers = F.when(impossible, F.array_union(plausible, F.array(F.lit("impossible to answer")))).otherwise(given)
    return rows.select(F.col("qa.id").alias("id"), "context", "qa.question", impossible.alias("is_impossible"), answers.alias("answers"))


def read_columnar(spark: SparkSession, path: str, text: str = "text", id_col: str | None = None, first: int | None = None) -> DataFrame:
    """Parquet rows with text; ``first`` keeps the leading rows by a dense index column."""
    rows = spark.read.parquet(path).filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.filter(F.col(id_col) < first) if first is not None else rows


PREDICTION_MAP = "map<string,struct<origin_prompt:string,prediction:string,gold:string>>"


def read_prediction_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Files ``name_<n>.json``, each one JSON object keyed by local position.

    Shards follow each other in number order up to the first missing number;
    the global position is the local one plus the sizes of earlier shards.
    Only the tiny table of shard sizes is ordered.
    """
    files = spark.read.text(pattern, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"_(\d+)\.json(?:/|$)", 1).cast("int").alias("shard"),
        F.from_json("value", PREDICTION_MAP).alias("m"),
    )
    w = Window.orderBy("shard")
    sizes = files.select("shard", F.size("m").cast("bigint").alias("n"))
    starts = sizes.select(
        "shard",
        (F.sum("n").over(w) - F.col("n")).alias("start"),
        (F.row_number().over(w) - 1).alias("place"),
    ).filter("shard = place")
    rows = files.select("shard", F.explode("m").alias("position", "r")).join(F.broadcast(starts), "shard")
    return rows.select(
        (F.col("position").cast("bigint") + F.col("start")).alias("position"),
        "r.origin_prompt", "r.prediction", "r.gold",
    )


def parse_judgements(df: DataFrame, parser: Callable[[Column], Column], text: str = "verdict_text") -> DataFrame:
    """Rows whose verdict parses."""
    return df.withColumn("verdict", parser(F.col(text))).filter(F.col("verdict").isNotNull())


def parse_rate(df: DataFrame, parser: Callable[[Column], Column], by: list[str], text: str = "verdict_text") -> DataFrame:
    """Parsed share per slice; 95 % or less is marked."""
    rate = F.avg(F.when(parser(F.col(text)).isNotNull(), 1.0).otherwise(0.0))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("judgements"), rate.alias("parsed"))
    return rows.withColumn("warn", F.col("parsed") <= 0.95)
