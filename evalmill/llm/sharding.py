"""Minimax contiguous shards: the smallest capacity for which greedy filling needs no more shards than asked for.

Documents with equal texts form a group that is never cut. Groups stand in the order of a 64-bit hash of their
text. Their sizes are never gathered: the driver sees sums over ranges of hashes. A range is split further only
while a cut may fall inside it, so each round returns a bounded number of sums, and the last one is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import salted_rank
from evalmill.session import pin

#: Sums that a round may return: bounds what reaches the driver.
SUMS = 1 << 16


class Piece(NamedTuple):
    """Groups whose hash lies in [start, start + 2**width)."""

    start: int
    width: int
    size: int
    groups: int


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def group_key(text: Column) -> Column:
    """Order of the groups: a hash of the text with its sign kept; null texts are one group."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def fits(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy check over ordered atoms: the start of every shard, or None if ``shards`` are too few."""
    if any(s > capacity for s in sizes):
        return None
    sums = [0, *accumulate(sizes)]
    starts, at = [], 0
    while at < len(sizes):
        if len(starts) == shards:
            return None
        starts.append(at)
        at = bisect_right(sums, sums[at] + capacity) - 1
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search between what any cut needs and one shard for all."""
    low, high = max([-(-sum(sizes) // shards), *sizes, 0]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if fits(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def reach(pieces: list[Piece], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where greedy shards 0, 1, ... end, in bytes. ``fluid``: pieces of several groups may be cut anywhere.

    True cuts lie between both ways of reading a piece: whole, as one atom, or fluid.
    """
    sums = [0, *accumulate(p.size for p in pieces)]
    ends, at = [], 0
    for _ in range(shards):
        target = min(at + capacity, sums[-1])
        i = bisect_right(sums, target) - 1
        whole = i == len(pieces) or not fluid or pieces[i].groups == 1
        at = max(sums[i], at) if whole else target
        ends.append(at)
    return ends


def least_fluid(pieces: list[Piece], shards: int) -> int:
    """A capacity below which no cut at group boundaries exists."""
    total = sum(p.size for p in pieces)
    low, high = max([-(-total // shards), *[p.size for p in pieces if p.groups == 1], 0]), total
    while low < high:
        mid = (low + high) // 2
        if reach(pieces, mid, shards, True)[-1] < total:
            low = mid + 1
        else:
            high = mid
    return low


def ambiguous(pieces: list[Piece], shards: int) -> list[Piece]:
    """Pieces of several groups that a capacity between both bounds may cut: about shards ** 2 of them at most."""
    low, high = least_fluid(pieces, shards), smallest_capacity([p.size for p in pieces], shards)
    ranges = list(zip(reach(pieces, low, shards, False), reach(pieces, high, shards, True)))
    sums = [0, *accumulate(p.size for p in pieces)]
    return [p for p, a, b in zip(pieces, sums, sums[1:]) if p.groups > 1 and any(a <= most and b > least for least, most in ranges)]


def even_ends(pieces: list[Piece], capacity: int, shards: int, large: list[tuple[int, int]]) -> tuple[list[int], list[Piece]]:
    """Piece indices where shards 0, 1, ... end, near equal shares of what is left, and the pieces to refine first.

    ``large``: (key, size) of the largest groups. Those above the fair share count as a shard each, the others share
    what is left. No shard exceeds ``capacity``, and each leaves no more than the shards after it can hold.
    """
    sums = [0, *accumulate(p.size for p in pieces)]
    todo: list[Piece] = []
    total, big = sums[-1], []
    while more := [x for x in large if x not in big and x[1] * (shards - len(big)) > total - sum(size for _, size in big)]:
        big += more
    starts = [p.start for p in pieces]
    big_at = sorted((bisect_right(starts, key) - 1, size) for key, size in big)
    least = [len(pieces)]  # least[k]: the first piece from which k shards hold all that follows
    for _ in range(shards):
        target = sums[least[-1]] - capacity
        i = bisect_left(sums, max(target, 0))
        if target > 0 and sums[i] > target and pieces[i - 1].groups > 1:
            todo.append(pieces[i - 1])
        least.append(min(i, least[-1]))
    ends, at = [], 0
    for left in range(shards, 0, -1):
        if at == len(pieces):
            break
        ahead = [size for i, size in big_at if i >= at]
        free = max(left - len(ahead), 1)
        target = sums[at] + min(capacity, max(-(-(total - sums[at] - sum(ahead)) // free), 1)) if left > 1 else total
        i = bisect_right(sums, target) - 1
        if i < len(pieces) and sums[i] < target:
            if pieces[i].groups > 1:
                todo.append(pieces[i])
            over = sums[i + 1] - target < target - sums[i] and sums[i + 1] - sums[at] <= capacity
            i += over or i == at
        at = max(i, least[left - 1])
        ends.append(at)
    return ends, list(dict.fromkeys(todo))


def even_cuts(groups: DataFrame, capacity: int, shards: int) -> list[int]:
    """First hash of shards 1, 2, ... of near equal sizes under the capacity, from groups(key, size) with unique keys."""
    # one row per shard reaches the driver
    large = [(r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect()]
    pieces = split(groups, [Piece(0, 64, 0, 2)], None)
    while True:
        ends, todo = even_ends(pieces, capacity, shards, large)
        if not todo:
            return [pieces[i].start for i in ends if i < len(pieces)]
        width = max(p.width for p in todo)
        wide = [p for p in todo if p.width == width]
        pieces = sorted([p for p in pieces if p not in set(wide)] + split(groups, wide, width))


def cut_hashes(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of shards 1, 2, ... when each is filled to the capacity, and the capacity, from groups(key, size) with
    unique keys."""
    pieces = split(groups, [Piece(0, 64, 0, 2)], None)
    while todo := ambiguous(pieces, shards):
        width = max(p.width for p in todo)
        wide = [p for p in todo if p.width == width]
        pieces = sorted([p for p in pieces if p not in set(wide)] + split(groups, wide, width))
    sizes = [p.size for p in pieces]
    capacity = smallest_capacity(sizes, shards)
    return [pieces[i].start for i in (fits(sizes, capacity, shards) or [])[1:]], capacity


def split(groups: DataFrame, pieces: list[Piece], width: int | None) -> list[Piece]:
    """The non-empty parts of pieces of one width; without a width, of everything."""
    bits = max(2, (SUMS // len(pieces)).bit_length() - 1)
    finer = max((64 if width is None else width) - bits, 0)
    if width is not None:
        blocks = F.shiftright("key", width)
        groups = groups.filter(blocks.isin([p.start >> width for p in pieces]))
    found = groups.groupBy(F.shiftright("key", finer).alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted(Piece(r["part"] << finer, finer, r["size"], r["n"]) for r in found)


def shard_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_size``, ``_shard`` (0 to shards - 1) and ``_slot`` (gapless from 0 in its shard).

    Law: bytes. Equal texts (null ones too) stay together, so no shard is smaller than its largest group allows;
    the largest shard is as small as any cut of the ordered groups can make it, and under that size the shards get near
    equal parts: one that a large group fills leaves the others to share the rest. With fewer groups than shards the
    last shards stay empty. Repeated rows each get a slot. An empty table gives an empty one.
    """
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {"_size", "_shard", "_slot", "_key"}], size_of(F.col(f"`{text}`")).alias("_size"), group_key(F.col(f"`{text}`")).alias("_key"))
    groups = pin(keyed.groupBy(F.col("_key").alias("key")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows")))
    rows = groups.agg(F.sum("rows")).first()[0] or 0
    _, capacity = cut_hashes(groups, shards)
    cuts = even_cuts(groups, capacity, shards)
    out = keyed.withColumn("_shard", shard_of(F.col("_key"), cuts))
    ids = F.col(f"`{id_col}`")
    return salted_rank(out, ["_shard"], F.xxhash64(ids, F.lit(7)), [ids, F.col("_key")], rows, rank="_slot").drop("_key")
