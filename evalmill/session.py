"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "evalmill") -> SparkSession:
    """A session for tests and the bench; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="evalmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/evalmill/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table kept in fewer pieces than there are cores; others stay as they are.

    A file with one row group is one task, whatever its size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one table feeds several jobs and must be the same in each of
    them, also after an executor was lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pin")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
