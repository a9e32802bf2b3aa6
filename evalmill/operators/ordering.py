"""Ranks, running sums and exact selection that hold when one group is huge.

A plain ``row_number() over (partition by g order by x)`` sorts the whole of
``g`` in one task. Here rows are dealt by ranges of (g, x, tie), so a huge group,
or one heavy value, is cut into as many slots as its size asks for (the rows are counted first); slot totals
(a tiny table) give every slot its starting offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.session import pin


#: Rows that a range holds about; a table has as many ranges as it takes, and one per shuffle partition at least.
SLOT_ROWS = 1_000_000


def range_slots(df: DataFrame, columns: Sequence[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``_slot``, the number of the row's range in the order of ``columns``.

    Spark samples the ranges; they are written once, as a number that is computed again may differ.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-df.count() // slot_rows))
    return pin(df.repartitionByRange(ranges, *columns).withColumn("_slot", F.spark_partition_id()))


def dealt(df: DataFrame, keys: Sequence[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as their number asks for, so that none groups many more than ``slot_rows`` of them.

    A group by ``keys`` (and more) that follows needs no further shuffle.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // slot_rows)), *keys)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Column,
    tie: Column,
    sums: dict[str, Column] | None = None,
    rank: str | None = "rank",
) -> DataFrame:
    """Add ``rank`` (1-based) and inclusive running sums inside each ``by`` group.

    ``order`` and ``tie`` are numeric and not null; negate them for descending
    order. ``by`` columns are not null. Groups of any size are split.
    """
    sums = sums or {}
    by = list(by)
    work = df.withColumn("_o", order).withColumn("_t", tie)
    for name, value in sums.items():
        work = work.withColumn(f"_v_{name}", value)
    work = range_slots(work, [*by, "_o", "_t"])
    totals = work.groupBy(*by, "_slot").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums],
    )
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = totals.select(
        *by,
        "_slot",
        F.coalesce(F.sum("_n").over(before), zero).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), zero).alias(f"_s0_{name}") for name in sums],
    )
    inside = Window.partitionBy(*by, "_slot").orderBy("_o", "_t")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_rn", F.row_number().over(inside))
    for name in sums:
        work = work.withColumn(f"_c_{name}", F.sum(f"_v_{name}").over(upto))
    out = work.join(starts, [*by, "_slot"])
    cols = [F.col(c) for c in df.columns]
    if rank:
        cols.append((F.col("_rn") + F.col("_n0")).cast("bigint").alias(rank))
    cols += [(F.col(f"_c_{name}") + F.col(f"_s0_{name}")).alias(name) for name in sums]
    return out.select(*cols)


def smallest(df: DataFrame, key: Column, tie: str, n: int, direct: int | None = None) -> DataFrame:
    """Exactly the ``n`` rows with the smallest 64-bit ``key``, as a filter.

    Digit by digit (16 bits each) the key's histogram tells where the n-th
    smallest lies; at most 65,536 counts reach the driver, and only rows of one
    equal key are sorted. ``direct`` is still taken from callers and changes nothing.
    """
    work = df.withColumn("_k", key)
    chosen, left, inside = F.lit(False), n, F.lit(True)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("_k", shift)
        counts = sorted(
            (r["d"], r["n"])
            for r in work.filter(inside).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        cut, size = None, 0
        for value, count in counts:
            if left <= count:
                cut, size = value, count
                break
            left -= count
        if cut is None:
            return df
        chosen = chosen | (inside & (digit < F.lit(cut)))
        inside = digit == F.lit(cut)
        if size == left:
            break
    below = work.filter(chosen)
    last = work.filter(inside).orderBy("_k", tie).limit(left)
    return below.unionByName(last).drop("_k")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. ``rank <= k`` lets Spark cut each group to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
