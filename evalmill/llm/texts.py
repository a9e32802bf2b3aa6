"""What several operators share: words of Arrow text columns, bounded slices of a batch, ranks without a global sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text each (a longer text stands alone): bounds a worker's memory."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice in order, and how many each row has. Null texts have none."""
    # taken into buffers of their own: on a slice, lower-casing after the cast reads beside the texts
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    flat, parents = flat.filter(keep), parents.filter(keep)
    counts = np.bincount(np.asarray(parents, dtype=np.int64), minlength=len(texts))
    return flat, counts


def bounds(counts: np.ndarray) -> np.ndarray:
    """Start of every row in the flat values, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def pick_lists(index: np.ndarray, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate list ``index[0]``, ``index[1]``, ... of the ragged ``values``; list i is values[ends[i]:ends[i+1]]."""
    lengths = np.diff(ends)[index]
    total = bounds(lengths)
    steps = np.arange(total[-1], dtype=np.int64) - np.repeat(total[:-1] - ends[:-1][index], lengths)
    return values[steps], total


def salted_rank(df: DataFrame, by: Sequence[str], spread: Column, order: Sequence[Column], rows: int, per_slot: int = 50_000, rank: str = "rank") -> DataFrame:
    """0-based gapless rank within ``by`` groups of any size.

    A group is dealt over slots by the hash ``spread``; the slots' counts (a small table) give each slot its
    first rank and only the rows of a slot are sorted together. Ranks follow the slots, then ``order``.
    """
    slots = max(64, -(-rows // per_slot))
    work = df.withColumn("_slot", F.pmod(spread, F.lit(slots)).cast("int"))
    counts = work.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slot").alias("_by_slot"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_slot").orderBy(*order)
    work = work.withColumn("_rn", F.row_number().over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_slot") == F.col("_by_slot")]
    out = work.join(starts, same)
    return out.select(*df.columns, (F.col("_first") + F.col("_rn") - 1).cast("bigint").alias(rank))
