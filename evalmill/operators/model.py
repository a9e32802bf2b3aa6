"""The boundary to models: user functions run over batches, and finished work is not run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evalmill.operators.align import pending_work


def score_with_model(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], output: str, batch: int = 64, samples: int = 1
) -> DataFrame:
    """Run a user's model over the rows: ``load()`` once per task, then one call per ``batch`` rows.

    The model returns the ``output`` columns for its rows in order. A batch that
    fails is retried row by row; rows that still fail carry the message in ``error``.
    With ``samples`` > 1 every row is asked that often (column ``sample_id``).
    """
    rows = df.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 1 else df
    names = [part.strip().split()[0] for part in output.split(",")]

    def attempt(model, part: pd.DataFrame) -> pd.DataFrame:
        said = model(part.reset_index(drop=True))
        if len(said) != len(part):
            raise ValueError(f"the model returned {len(said)} rows for {len(part)}")
        out = part.reset_index(drop=True)
        for name in names:
            out[name] = said[name].to_numpy()
        return out.assign(error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    yield attempt(model, part)
                except Exception:
                    for i in range(len(part)):
                        one = part.iloc[i : i + 1]
                        try:
                            yield attempt(model, one)
                        except Exception as err:
                            yield one.assign(**{n: None for n in names}, error=str(err))

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, {output}, error string")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The output written so far; None only where there is no folder or nothing in it yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resume(tasks: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do only the rows whose keys are not yet in the output folder, append them, and return the whole output."""
    spark = tasks.sparkSession
    done = existing(spark, path)
    left = tasks if done is None else pending_work(tasks, done.select(*keys).distinct(), keys)
    work(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
