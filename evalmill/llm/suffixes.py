"""Bytes covered by long strings that occur elsewhere, by sorting the suffixes of the texts one bucket at a time.

Two suffixes matter to each other if their first ``size`` bytes (a window) are equal. So that such suffixes meet, and
neighbours travel together, the bucket of a suffix is not named by its first bytes but by the substring of ``SEED``
bytes with the smallest hash in its window: equal windows hold the same one. Neighbouring suffixes mostly have the same
bucket and are sent as one segment of text. Segments that stand somewhere else as a whole are settled by counting;
buckets with a single segment, in which their substring stands once, have nothing to find.

Inside a bucket suffixes are sorted by their first and last eight bytes. Long ties are resolved by the ranks of a
difference cover sample: of the places whose remainder by 7 is 0, 1 or 3. For any two places some shift below 7 moves
both into the sample, so two tied windows are equal if and only if the sample places at that shift have equal ranks.
Ranks are computed before, for the sample only, by doubling the depth up to the window's length. Only one bucket is in
memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.periods import NONE, Hashes, mixed, smallest_within
from evalmill.llm.texts import bounds, slices
from evalmill.session import pin

SIZE, SEED = 400, 64
COVER, MODULUS = (0, 1, 3), 7
#: Bytes of segments in a partition of buckets, and in one sorting; segments from which a bucket is split by window.
BUCKET_BYTES, SORT_BYTES, HOT = 16 << 20, 1 << 20, 4096
WORD = 8
BYTE_CODES = mixed(np.arange(256))


def key_columns(body):
    """A text's identity: 120 bits of its MD5 as two numbers."""
    digest = F.md5(body.cast("binary"))
    return [F.conv(F.substring(digest, a, 15), 16, 10).cast("bigint").alias(k) for k, a in (("k1", 1), ("k2", 16))]


def segments_of(data: np.ndarray, counts: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows and bucket of every segment of texts that stand one after another.

    Last comes whether a segment may hold one window twice, which needs its bucket's substring twice.
    """
    ends = bounds(counts)
    windows = np.maximum(counts - size + 1, 0)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    hashes = mixed(Hashes(data, BYTE_CODES).windows(seed))
    reach = size - seed + 1
    low = smallest_within(hashes, reach)
    # a substring names a bucket if some window over it has no smaller one; of one segment such places are neighbours
    edge = np.full(reach - 1, NONE)
    named = np.flatnonzero(~smallest_within(np.concatenate([edge, ~low, edge]), reach) == hashes)
    near = (hashes[named[1:]] == hashes[named[:-1]]) & (np.diff(named) <= reach)
    twice = np.unique(hashes[named[1:][near]])
    doc = np.repeat(np.arange(len(counts)), windows)
    total = bounds(windows)
    at = np.arange(total[-1]) + np.repeat(ends[:-1] - total[:-1], windows)
    low = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    bucket = low[first]
    return doc[first], at[first] - ends[:-1][doc[first]], np.diff(np.append(first, len(at))), bucket, np.isin(bucket, twice)


def ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes at every place as a number in byte order; zeros follow the end."""
    filled = np.concatenate([data, np.zeros(2 * WORD, np.uint8)])
    out = np.empty(-(-len(data) // WORD) * WORD, dtype=np.uint64)
    for r in range(WORD):
        out[r::WORD] = filled[r : r + len(out)].view(">u8")
    return out[: len(data)]


def sample_ranks(words: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Ranks of the cover sample by the first bytes, and how many: size - 7 at least, size - 6 at most.

    Sample j is place 7 * (j // 3) + COVER[j % 3]; three samples on stand seven places on. Ranks of samples whose bytes
    reach beyond their segment mean nothing.
    """
    rounds = -(-len(words) // MODULUS)
    place = (np.arange(rounds)[:, None] * MODULUS + np.array(COVER)).ravel()
    held = np.append(words, np.zeros(MODULUS, np.uint64))
    rank, depth = ranks(held[place]), WORD
    while depth < size - MODULUS:
        shift = min(depth, size - MODULUS + 1 - depth) // MODULUS
        ahead = shift * len(COVER)
        if not shift or ahead >= len(rank):
            break
        rank = ranks(rank[:-ahead] << np.uint64(32) | rank[ahead:])
        depth += shift * MODULUS
    return rank, depth


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which values stand there twice or more."""
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[where] > 1


def repeated_windows(segments: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For every segment, which of its windows stand in any segment twice or more. The segments are distinct."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    windows = lengths - size + 1
    starts, total = bounds(lengths), bounds(windows)
    words = eight_bytes(np.frombuffer(b"".join(segments), np.uint8))
    at = np.arange(total[-1]) + np.repeat(starts[:-1] - total[:-1], windows)
    first, last = words[at], words[at + size - WORD]
    order = np.lexsort((last, first))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (last[order][1:] != last[order][:-1])
    group = np.cumsum(new)
    alone = new & np.append(new[1:], True)
    tied, group = order[~alone], group[~alone].astype(np.uint64)
    found = np.zeros(len(at), dtype=bool)
    if len(tied):
        rank, depth = sample_ranks(words, size)
        # first word, sample bytes and last word cover the window whatever the shift
        assert MODULUS - 1 <= WORD and depth >= size - WORD and depth + MODULUS - 1 <= size
        index = np.full(MODULUS, -1)
        index[list(COVER)] = np.arange(len(COVER))
        for shift in range(MODULUS):
            place = at[tied] + shift
            inside = index[place % MODULUS] >= 0
            sample = (place // MODULUS) * len(COVER) + index[place % MODULUS]
            here = np.flatnonzero(inside)
            same = repeated(group[here] << np.uint64(32) | rank[sample[here]])
            found[tied[here[same]]] = True
    return [found[a:b] for a, b in zip(total[:-1], total[1:])]


def stretches(flags: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the bytes under the marked windows; stretches may touch."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + size


PLACES = "m bigint, seg bigint, k1 bigint, k2 bigint, start bigint, n bigint, own boolean"
FOUND = "m bigint, seg bigint, spans array<struct<lo: bigint, hi: bigint>>"


def span_list(spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = pa.array(bounds(np.array([len(a) for a, _ in spans], dtype=np.int64)).astype(np.int32))
    flat = [pa.array(np.concatenate([s[i] for s in spans]).astype(np.int64) if spans else np.zeros(0, np.int64)) for i in (0, 1)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["lo", "hi"]))


def list_segments(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """Every segment of texts(k1, k2, body): bucket, digest, place and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                bodies = [b.as_py() for b in part.column("body")]
                held = b"".join(bodies)
                counts = np.array([len(b) for b in bodies], dtype=np.int64)
                doc, start, n, bucket, own = segments_of(np.frombuffer(held, np.uint8), counts, size, seed)
                place = bounds(counts)[:-1][doc] + start
                view = memoryview(held)
                digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + c + size - 1]) for a, c in zip(place.tolist(), n.tolist())), np.uint64, len(n))
                keys = [np.asarray(part.column(k), dtype=np.int64)[doc] for k in ("k1", "k2")]
                columns = [bucket.view(np.int64), digest.view(np.int64), *keys, start, n, own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "seg", "k1", "k2", "start", "n", "own"])

    return texts.mapInArrow(run, PLACES)


def cut_segments(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The bytes of the wanted segments, (m, seg, segs, body): a text is cut once for all of its segments."""
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "seg", "segs", "start", "n")).alias("asked"))
    # copies of a text give the same segments
    once = texts.dropDuplicates(["k1", "k2"]).join(asked, ["k1", "k2"]).select("body", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                asked_rows = part.column("asked")
                flat = asked_rows.flatten()
                owner = np.repeat(np.arange(len(part)), np.asarray(asked_rows.value_lengths()))
                bodies = [b.as_py() for b in part.column("body")]
                start, n = (np.asarray(flat.field(c)).tolist() for c in ("start", "n"))
                cut = [bodies[d][a : a + c + size - 1] for d, a, c in zip(owner.tolist(), start, n)]
                for a in range(0, len(cut), 4096):
                    own = slice(a, a + 4096)
                    yield pa.RecordBatch.from_arrays([*[flat.field(c)[own] for c in ("m", "seg", "segs")], pa.array(cut[own], pa.binary())], ["m", "seg", "segs", "body"])

    return once.mapInArrow(run, "m bigint, seg bigint, segs bigint, body binary")


def sort_buckets(segments: DataFrame, size: int, partitions: int) -> DataFrame:
    """Spans of repeated windows of every segment that has any, bucket by bucket."""

    def solved(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        marked = [stretches(f, size) for f in repeated_windows([r[2] for r in rows], size)]
        kept = [i for i, (a, _) in enumerate(marked) if len(a)]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in kept], pa.int64()), pa.array([rows[i][1] for i in kept], pa.int64()), span_list([marked[i] for i in kept])], ["m", "seg", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        held = 0
        for batch in batches:
            for m, seg, body in zip(*(batch.column(c).to_pylist() for c in ("m", "seg", "body"))):
                if held >= SORT_BYTES and rows[-1][0] != m:
                    yield solved(rows)
                    rows, held = [], 0
                rows.append((m, seg, body))
                held += len(body)
        if rows:
            yield solved(rows)

    dealt = segments.select("m", "seg", "body").repartition(partitions, "m").sortWithinPartitions("m")
    return dealt.mapInArrow(run, FOUND)


def split_buckets(segments: DataFrame, size: int) -> DataFrame:
    """The same for buckets of any size: every window is dealt by its own 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, seg, body in zip(*(batch.column(c).to_pylist() for c in ("m", "seg", "body"))):
                view, n = memoryview(body), len(body) - size + 1
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + size]) for i in range(n)), np.int64).reshape(n, 2)
                columns = [np.full(n, m), np.full(n, seg), np.arange(n), hashes[:, 0], hashes[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "seg", "at", "h1", "h2"])

    windows = segments.mapInArrow(run, "m bigint, seg bigint, at bigint, h1 bigint, h2 bigint")
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2")
    spans = F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + size).alias("hi")))
    return windows.join(again, ["h1", "h2"]).groupBy("m", "seg").agg(spans.alias("spans"))


def covered_spans(texts: DataFrame, size: int, seed: int, hot: int) -> DataFrame:
    """k1, k2 and the covered spans (lo, hi; they may overlap) of every text that has any."""
    places = pin(list_segments(texts, size, seed))
    first = [F.first(c).alias(c) for c in ("k1", "k2", "start", "n")]
    distinct = places.groupBy("m", "seg").agg(F.count(F.lit(1)).alias("copies"), F.max("own").alias("own"), *first)
    shared = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("segs"), F.max("own").alias("within")).filter("segs > 1 or within").drop("within")
    wanted = pin(distinct.join(shared, "m"))
    total = wanted.agg(F.sum(F.col("n") + size - 1)).first()[0] or 0
    cut = pin(cut_segments(texts, wanted, size))
    sorted_out = sort_buckets(cut.filter(F.col("segs") <= hot), size, max(1, -(-total // BUCKET_BYTES)))
    split_out = split_buckets(cut.filter(F.col("segs") > hot), size)
    whole = distinct.filter("copies > 1").select("m", "seg", F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("n") + size - 1).alias("hi"))).alias("spans"))
    inside = sorted_out.unionByName(split_out).join(distinct.filter("copies > 1").select("m", "seg"), ["m", "seg"], "left_anti")
    found = pin(whole.unionByName(inside))
    hits = places.join(found, ["m", "seg"]).select("k1", "k2", "start", F.explode("spans").alias("s"))
    # copies of a text have the same spans
    spans = hits.select("k1", "k2", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi")).distinct()
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def united(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans joined, in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], axis=1)


SCHEMA = "n_bytes bigint, spans array<struct<lo: bigint, hi: bigint>>, kept binary"


def drop_repeats(docs: DataFrame, text: str = "text", size: int = SIZE, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """A row per document: ``row`` (all its columns, as a struct), n_bytes, spans (removed, from 0, end exclusive), kept.

    A byte goes if a string of ``size`` bytes over it starts at another place too, in any document; strings are judged
    on the texts as given and do not cross documents. ``kept`` holds the other bytes, which may end inside a character.
    Null and empty texts, and texts below ``size`` bytes, lose nothing. Of repeated rows and equal texts of ``size``
    bytes or more every one goes as a whole. Other columns may have any name. Buckets of more than ``hot`` distinct
    segments are split by window. ``size`` is a multiple of 8 and at least ``seed``; size - 1 is a multiple of 7.
    """
    if size % WORD or (size - 1) % MODULUS or seed > size:
        raise ValueError("this window size is not provided for")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.cast("binary").alias("body"), *key_columns(body))
    texts = work.filter(F.octet_length("body") >= size).select("k1", "k2", "body")
    covers = pin(covered_spans(texts, size, seed, hot))
    # the text moves once, in its row
    joined = work.drop("body").join(covers, ["k1", "k2"], "left").select("row", "spans")
    kind, place = work.schema["row"].dataType.simpleString(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pc.fill_null(pc.struct_field(batch.column("row"), [place]).cast(pa.binary()), b"")
            for part in slices(batch.append_column("body", bodies), "body"):
                given = part.column("spans").fill_null([]) if part.column("spans").null_count else part.column("spans")
                flat = given.flatten()
                pairs = np.stack([np.asarray(flat.field("lo"), dtype=np.int64), np.asarray(flat.field("hi"), dtype=np.int64)], axis=1)
                ends = bounds(np.asarray(given.value_lengths(), dtype=np.int64))
                sizes, spans, kept = [], [], []
                for n, b in enumerate(part.column("body")):
                    data = b.as_py()
                    own = united(pairs[ends[n] : ends[n + 1]])
                    edges = [0, *own.ravel().tolist(), len(data)]
                    sizes.append(len(data))
                    spans.append((own[:, 0], own[:, 1]))
                    kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sizes, pa.int64()), span_list(spans), pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"row {kind}, {SCHEMA}")
