"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.session import spread

# tables of long texts: most of their work is done inside the row
TEXT_TABLES = {"documents", "pages", "conversations"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, plus the derived evaluation tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    def wide(self, name: str) -> DataFrame:
        """A derived table on every core, for queries that do much work per row."""
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        from evalmill.plans.fixtures import DERIVED

        if name.startswith("_"):
            raise AttributeError(name)
        if name in DERIVED:
            needs, text = DERIVED[name]
            return self.spark.sql(text, **{n: getattr(self, n) for n in needs})
        return self.read(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
