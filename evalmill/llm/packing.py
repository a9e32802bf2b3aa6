"""Vector best-fit packing: tokens, documents and attention cost are three capacities of every sequence.

All that packing needs of a piece is its length, so the bins are planned on the histogram of lengths: at most one
entry per length, whatever the corpus. Equal bins are kept as one entry with a count. Pieces then find their place
by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import bounds, pick_lists, salted_rank, slices, split_words
from evalmill.llm.tokens import distinct, lists_encoder, tokenizer_json
from evalmill.session import pin

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, first_rank bigint, last_rank bigint, first_bin bigint, per_bin bigint, base bigint"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. A piece of n tokens costs (n, 1, n * n); the defaults of the last two never bind."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


def plan_bins(histogram: Mapping[int, int], limits: Limits = Limits(), weights=(1.0, 1e-9, 1e-9), rule: str = "norm") -> list[tuple]:
    """Rows of PLAN: pieces of ``length`` with rank in [first_rank, last_rank) go to bins from ``first_bin`` on,
    ``per_bin`` to each, behind ``base`` tokens.

    Lengths come longest first. The bin for a piece is the one that holds it under every capacity and has the
    smallest weighted norm of what stays free ("norm") or the largest weighted dot-product of demand and free
    room ("dot"); a bin that wins keeps winning while the piece fits, so a run of equal bins is filled at once.
    """
    full = limits.vector()
    scale = np.asarray(weights, dtype=float)
    free = np.zeros((0, 3), dtype=np.int64)
    first, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = int(histogram[length]), 0
        while left:
            able = np.flatnonzero((free >= need).all(axis=1))
            if len(able):
                part = free[able] / full
                if rule == "norm":
                    score = (scale * ((free[able] - need) / full) ** 2).sum(axis=1)
                else:
                    score = -(scale * part * (need / full)).sum(axis=1)
                at = int(able[np.lexsort((first[able], score))[0]])
            else:
                per = int((full // need).min())
                free = np.vstack([free, full])
                first, count = np.append(first, opened), np.append(count, -(-left // per))
                at, opened = len(free) - 1, opened + -(-left // per)
            room, start, bins = free[at].copy(), int(first[at]), int(count[at])
            per = int((room // need).min())
            whole = min(bins, left // per)
            base = int(full[0] - room[0])
            parts = []
            if whole:
                rows.append((length, rank, rank + whole * per, start, per, base))
                rank, left = rank + whole * per, left - whole * per
                parts.append((room - per * need, start, whole))
            if left and whole < bins:
                rows.append((length, rank, rank + left, start + whole, per, base))
                parts.append((room - left * need, start + whole, 1))
                whole, rank, left = whole + 1, rank + left, 0
            if whole < bins:
                parts.append((room, start + whole, bins - whole))
            parts = [p for p in parts if (p[0] > 0).all()]
            keep = np.arange(len(free)) != at
            free = np.vstack([free[keep], *[p[0][None] for p in parts]])
            first = np.concatenate([first[keep], [p[1] for p in parts]]).astype(np.int64)
            count = np.concatenate([count[keep], [p[2] for p in parts]]).astype(np.int64)
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most ``limit`` tokens: the id, piece, start, length and crc of its ids.

    A document's ids are those of its text (null: empty) and ``end_id``. The vocabulary drops white space, so a text's
    ids are those of its words one after another; every distinct word of a slice is encoded once.
    """
    spec = tokenizer_json(tokenizer)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lists_encoder(spec)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = split_words(part.column("text"), lower=False)
                words, index = distinct(flat)
                values, ends = encode(words)
                ids, edges = pick_lists(index, values, ends)
                edges = edges[bounds(counts)]
                out = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), edges, edges[1:]):
                    whole = np.append(ids[a:b], end_id).astype("<u4")
                    for piece, at in enumerate(range(0, len(whole), limit)):
                        one = whole[at : at + limit]
                        out.append((doc, piece, at, len(one), zlib.crc32(one.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(cut, f"doc_id bigint, {PIECES}")


def pack(pieces: DataFrame, limits: Limits = Limits(), rule: str = "norm") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces(doc_id, piece, length, ...). No row gives no row."""
    pieces = pin(pieces)
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_bins(histogram, limits, rule=rule), PLAN).withColumnRenamed("length", "_length")
    ranked = salted_rank(pieces, ["length"], F.xxhash64("doc_id", "piece"), [F.col("doc_id"), F.col("piece")], sum(histogram.values()), rank="_rank")
    # a plan has at most a few rows per length, and there are at most `tokens` lengths: small for any corpus
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("last_rank")))
    step = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), rule: str = "norm", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than a sequence are cut. A null or empty text is its end token alone. Repeated rows are
    packed each. Other columns of ``docs`` are not carried.
    """
    longest = min(limits.tokens, int(limits.attention**0.5))
    return pack(token_pieces(docs, tokenizer, longest, id_col=id_col, text=text), limits, rule)
