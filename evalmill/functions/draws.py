"""Random draws that depend on nothing but a seed and the keys of what is drawn.

A draw is the first 60 bits of the MD5 of ``seed:key:key...``, so any engine with MD5 draws the same: a recomputed
task, another partitioning or another system gives the same rows. ``sql_bits`` and its kin say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 1 << 52


def bits(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 2**60). Null keys count as absent."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1), a multiple of 2**-52."""
    return F.shiftright(bits(seed, *keys), 8) / float(UNIT)


def below(n: Column | int, seed: int, *keys: Column | str) -> Column:
    """A number in [0, n)."""
    return bits(seed, *keys) % n


def in_drawn_order(items: Column, seed: int, *keys: Column | str) -> Column:
    """Array shuffled per row."""
    keyed = F.transform(items, lambda x, i: F.struct(bits(seed, *keys, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def sql_bits(seed: int, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 15) AS BIGINT)"


def sql_uniform(seed: int, *keys: str) -> str:
    return f"(({sql_bits(seed, *keys)} >> 8) / {UNIT}e0)"


def sql_drawn_order(items: str, seed: int, *keys: str) -> str:
    """A SQL list in drawn order; places count from 0."""
    keyed = f"list_transform({items}, lambda x, i: {{'h': {sql_bits(seed, *keys, 'i - 1')}, 'i': i, 'x': x}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.x)"


def sql_distinct(total: str, k: int, seed: int, *keys: str) -> str:
    """SQL list of k different numbers below ``total`` by Floyd's method, in drawn order (see ``retrieve.draw_distinct``)."""
    draw = sql_bits(seed, *keys, "j")
    key = ", ".join(keys)
    steps = f"list_prepend([]::BIGINT[], list_transform(range(greatest({total} - {k}, 0), {total}), lambda j: [j, {draw} % (j + 1)]))"
    drawn = f"list_reduce({steps}, lambda a, s: list_append(a, CASE WHEN list_contains(a, s[2]) THEN s[1] ELSE s[2] END))"
    keyed = f"list_transform({drawn}, lambda x: {{'h': {sql_bits(seed + 1, key, 'x')}, 'x': x}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.x)"
