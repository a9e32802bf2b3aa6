"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt over shards by a hash, queries over large blocks; a task holds one shard and one block, builds the
shard's tree once and searches it for the whole block, with matrix products for bounds and leaves. A first pass
looks only into the leaf with the best bound in every shard. The k-th best score it finds, over all shards, is a
score the true top k must reach: the second pass starts from it and opens only nodes that can still reach it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.session import pin

SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
LEAF = 256
FOUND = "query_id bigint, vec_id bigint, score bigint"


def scaled(vector: Column, scale: int = 64) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(False))


@dataclass
class BallTree:
    """Rows in tree order; a leaf is rows[first:last]. Node arrays: center, radius, children (-1: leaf), first, last."""

    rows: np.ndarray
    ids: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build_tree(rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Split at the median of the projection between two far points; equal rows end in one leaf of radius 0."""
    order = np.argsort(ids, kind="stable")
    nodes: list[list] = []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = rows[order[a:b]]
        center = own.mean(axis=0)
        away = ((own - center) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        number = len(nodes)
        nodes.append([center, radius, -1, -1, a, b])
        if parent >= 0:
            nodes[parent][2 + side] = number
        far = own[away.argmax()]
        if b - a <= leaf or not ((own != far).any()):
            continue
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        along = own @ (other - far)
        middle = np.partition(along, (b - a) // 2)[(b - a) // 2]
        lower = along < middle
        if not lower.any():
            lower = along <= middle
            if lower.all():
                continue
        order[a:b] = np.concatenate([order[a:b][lower], order[a:b][~lower]])
        cut = a + int(lower.sum())
        todo += [(a, cut, number, 0), (cut, b, number, 1)]
    center, radius, left, right, first, last = (np.array(x) for x in zip(*nodes))
    return BallTree(rows[order], ids[order], center, radius.astype(float), left, right, first, last)


def best_of(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, queries: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best found of every query by score, ties to the smaller id; raises the floor of queries that have k."""
    order = np.lexsort((ids, -scores, owner))
    owner, scores, ids = owner[order], scores[order], ids[order]
    first = np.searchsorted(owner, np.arange(queries))
    near = np.arange(len(owner)) - first[owner] < k
    owner, scores, ids = owner[near], scores[near], ids[near]
    last = np.searchsorted(owner, np.arange(queries), side="right") - 1
    full = np.bincount(owner, minlength=queries) == k
    floor[full] = np.maximum(floor[full], scores[last[full]])
    return owner, scores, ids


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray, first_leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best k of the tree for every query with a score of its floor or more, without the query's own id; rows opened.

    One product gives the bounds of all nodes for all queries: query . center + |query| * radius, and never more than
    the parent's. The leaves are visited from the highest bound down; a leaf is one product with the queries that can
    still find something there. What is found raises their k-th scores. Bounds get a little slack for rounding. With
    ``first_leaf`` a query opens only its own best leaf (and further ones until it has k rows).
    """
    bounds = tree.center @ queries.T + tree.radius[:, None] * np.linalg.norm(queries, axis=1)
    bounds += 1e-9 * np.abs(bounds) + 1e-6
    for node in range(len(tree.left)):
        for child in (tree.left[node], tree.right[node]):
            if child >= 0:
                np.minimum(bounds[child], bounds[node], out=bounds[child])
    leaves = np.flatnonzero(tree.left < 0)
    bounds = bounds[leaves]
    floor = floors.astype(float)
    if first_leaf:
        # leaves by falling bound until they hold k rows besides the query's own
        order = np.argsort(-bounds, axis=0)
        sizes = (tree.last - tree.first)[leaves][order]
        needed = np.cumsum(sizes, axis=0) - sizes < k + 1
        opened = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(opened, order, needed, axis=0)
    found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, looked = 0, 0
    for n in np.argsort(-bounds.max(axis=1, initial=-np.inf)):
        asked = np.flatnonzero(opened[n] if first_leaf else bounds[n] >= floor)
        if not len(asked):
            continue
        a, b = tree.first[leaves[n]], tree.last[leaves[n]]
        looked += len(asked) * (b - a)
        scores = queries[asked] @ tree.rows[a:b].T
        q, r = np.nonzero((scores >= floor[asked][:, None]) & (own[asked][:, None] != tree.ids[a:b]))
        waiting.append((asked[q], scores[q, r], tree.ids[a:b][r]))
        held += len(q)
        if held > 2 * k * len(queries) + 100_000:
            found = best_of(*[np.concatenate([f, *w]) for f, w in zip(found, zip(*waiting))], k, len(queries), floor)
            waiting, held = [], 0
    if waiting:
        found = best_of(*[np.concatenate([f, *w]) for f, w in zip(found, zip(*waiting))], k, len(queries), floor)
    return *found, looked


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of one width, shorter ones filled with zeros. Doubles hold the products exactly below 2**53."""
    held = vectors.combine_chunks()
    lengths = np.asarray(held.value_lengths())
    flat = np.asarray(held.flatten(), dtype=np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` with the highest integer inner product.

    Components become floor(scale * x). Ties go to the smaller id; rows with the query's own id take no part, nor
    do unusable vectors (see ``usable``) or null ids. Shorter vectors count as filled up with zeros. Fewer than k
    candidates give fewer rows. Of rows with equal id and equal vector one is searched. Products must stay below
    2**53 to be exact, else an error is raised.
    """

    def prepared(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
        return own.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", scaled(F.col("v"), scale).alias("v")).distinct()

    # of equal vectors only the k + 1 smallest ids can be in a top k: the others lose every tie
    twins = Window.partitionBy("v", "slot").orderBy("vec_id")
    slots = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(32))
    base = pin(prepared(vectors).withColumn("slot", slots).withColumn("_n", F.row_number().over(twins)).filter(F.col("_n") <= k + 1).drop("_n", "slot"))
    asked = pin(prepared(queries).withColumnRenamed("vec_id", "query_id").withColumnRenamed("v", "q"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    number = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("w"), F.max(F.array_max(F.transform("q", F.abs))).alias("m")).first()
    width = max(size["w"] or 0, number["w"] or 0, 1)
    if (size["m"] or 0) * (number["m"] or 0) * width >= 1 << 53:
        raise ValueError("the products of these vectors are too large to be exact")
    shards = max(1, -(-size["n"] // SHARD_ROWS))
    blocks = max(1, -(-number["n"] // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).select("shard", every(blocks).alias("block"), "vec_id", "v")
    in_blocks = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def scan(first_leaf: bool):
        def run(asked_rows: pa.Table, held: pa.Table) -> pa.Table:
            columns = [np.zeros(0, np.int64)] * 3
            if asked_rows.num_rows and held.num_rows:
                tree = build_tree(matrix(held.column("v"), width), np.asarray(held.column("vec_id"), dtype=np.int64))
                own = np.asarray(asked_rows.column("query_id"), dtype=np.int64)
                floors = np.asarray(asked_rows.column("floor"), dtype=float)
                owner, scores, ids, _ = search(tree, matrix(asked_rows.column("q"), width), own, k, floors, first_leaf)
                columns = [own[owner], ids, scores.astype(np.int64)]
            return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

        return run

    def best(found: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    def meet(with_floor: DataFrame, first_leaf: bool) -> DataFrame:
        sent = with_floor.select(every(shards).alias("q_shard"), "q_block", "query_id", "q", F.col("floor").cast("double").alias("floor"))
        return sent.groupBy("q_shard", "q_block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(scan(first_leaf), FOUND)

    start = in_blocks.withColumn("floor", F.lit(float("-inf")))
    # a score counts towards the shared k-th best once per id
    firsts = best(meet(start, True).distinct()).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floors = pin(firsts.select(F.col("query_id").alias("f_id"), F.when(F.col("n") >= k, F.col("low")).alias("low")))
    known = in_blocks.join(floors, F.col("query_id") == F.col("f_id"), "left").withColumn("floor", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))))
    found = best(meet(known, False).distinct())
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
