"""Near duplicates: MinHash bands propose, a sequential Bayesian test prunes, full shingle sets decide.

Equal word sequences are one node. Nodes that share a band stand in a bucket; there signatures are compared batch
by batch, and a pair goes on only while the posterior probability that its similarity reaches the threshold is
above the chosen miss probability. The result needs the components of the link graph, so a bucket first sends only
a spanning forest of its survivors to the exact test. Buckets whose nodes are then still apart are compared once
more with the full sets at hand, and every survivor between two components is tested there, in the first band that
the pair shares. Each survivor is thus either tested or joins nodes that are linked already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.components import components
from evalmill.llm.texts import bounds, lower_ascii, slices, split_words, words_of
from evalmill.session import pin

#: Rows of a bucket that are compared in one group; larger buckets are cut into blocks that meet pair by pair.
BLOCK = 4096
#: Odd multipliers of the polynomial over the words of a shingle and of the mixing steps (SplitMix64).
STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Scheme:
    """``percent``: link at 100 * common >= percent * union. A pair at the threshold s shares no band with probability
    (1 - s**rows)**bands, 9e-7 here; ``miss`` bounds what a pruning step may lose."""

    percent: int = 85
    words: int = 5
    bands: int = 36
    rows: int = 7
    batch: int = 28
    miss: float = 1e-7
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> np.ndarray:
        """Fewest equal values after 1, 2, ... batches with which a pair goes on.

        Under a uniform prior, P(similarity >= s | m of n equal) = P(Binomial(n + 1, s) <= m).
        """
        s, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            out.append(m)
        return np.array(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For every text the digest of its word sequence (None without words) and its sorted distinct shingle hashes.

    A shingle of fewer words than ``words`` is the whole sequence of a short text; 64-bit hashes stand for shingles.
    """
    import xxhash

    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64)
    hashes = known[np.asarray(coded.indices, dtype=np.int64)] if len(flat) else np.zeros(0, np.uint64)
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for i in range(words):
        rolled = rolled * STEP + hashes[i : i + len(rolled)]
    rolled = mixed(rolled)
    ends = bounds(counts)
    for a, b in zip(ends, ends[1:]):
        if a == b:
            yield None, np.zeros(0, np.uint64)
            continue
        own = hashes[a:b]
        if b - a < words:
            one = np.uint64(b - a)
            for h in own:
                one = one * STEP + h
            yield blake2b(own.tobytes(), digest_size=16).digest(), mixed(np.array([one], np.uint64))
        else:
            yield blake2b(own.tobytes(), digest_size=16).digest(), np.unique(rolled[a : b - words + 1])


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, key (null without words or id), n_shingles, sig: the lowest 16 bits of every minimum."""
    rng = np.random.default_rng(scheme.seed)
    mul = rng.integers(0, 1 << 31, scheme.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, scheme.hashes, dtype=np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    keys, sizes, sigs = [], [], []
                    for key, own in shingle_sets(part.column("text"), scheme.words):
                        keys.append(key)
                        sizes.append(len(own))
                        if key is None:
                            sigs.append(None)
                            continue
                        x = (own >> np.uint64(32)).astype(np.uint32)
                        best = np.full(scheme.hashes, 0xFFFFFFFF, np.uint32)
                        for at in range(0, len(x), 1024):
                            np.minimum(best, (x[at : at + 1024, None] * mul + add).min(axis=0), out=best)
                        sigs.append((best & np.uint32(0xFFFF)).astype("<u2").tobytes())
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], schema=schema)

    out = docs.mapInArrow(sign, "doc_id bigint, key binary, n_shingles bigint, sig binary")
    return out.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key")))


def matching(sig: np.ndarray, others: np.ndarray, least: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``others`` that pass every step of the sequential test against ``sig``, and their equal values."""
    alive, equal = np.arange(len(others)), np.zeros(len(others), np.int32)
    for step, need in enumerate(least):
        part = slice(step * batch, (step + 1) * batch)
        equal = equal + (others[alive, part] == sig[part]).sum(axis=1, dtype=np.int32)
        good = equal >= need
        alive, equal = alive[good], equal[good]
        if not len(alive):
            break
    return alive, equal


@dataclass
class Bucket:
    """Rows of one group: keys, signatures, component numbers, band number and, in the last round, shingle sets."""

    keys: list[bytes]
    sigs: np.ndarray
    labels: np.ndarray
    place: int
    sets: list[np.ndarray] | None


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def bucket_pairs(rows: Bucket, left: np.ndarray, right: np.ndarray | None, scheme: Scheme, least: np.ndarray) -> list[tuple[int, int]]:
    """Pairs between rows ``left`` and ``right`` (None: among left) that join components, most alike first.

    Without sets these are survivors of the sequential test, with sets links: there all survivors that share no
    earlier band are tested, until their components are joined.
    """
    out, own = [], rows.labels.copy()
    for n, i in enumerate(left):
        rest = left[n + 1 :] if right is None else right
        rest = rest[own[rest] != own[i]]
        if not len(rest):
            continue
        near, equal = matching(rows.sigs[i], rows.sigs[rest], least, scheme.batch)
        near = rest[near]
        if rows.sets is not None and len(near):
            bands = (rows.sigs[near] == rows.sigs[i]).reshape(len(near), -1, scheme.rows).all(axis=2)
            first = bands.argmax(axis=1) == rows.place
            near, equal = near[first], equal[first]
        near = near[np.argsort(-equal, kind="stable")]
        while len(near):
            j, near = near[0], near[1:]
            if rows.sets is None or linked(rows.sets[i], rows.sets[j], scheme.percent):
                out.append((i, j))
                own[own == own[j]] = own[i]
                near = near[own[near] != own[i]]
    return out


def propose(members: DataFrame, scheme: Scheme) -> DataFrame:
    """Distinct pairs (a, b), a < b, from members(band, place, n, key, label, sig[, shingles]): see ``bucket_pairs``."""
    least, width = scheme.least_matches(), scheme.hashes
    exact = "shingles" in members.columns
    carried = ["place", "key", "label", "sig", *(["shingles"] if exact else [])]
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", own)
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *carried)
    dealt = placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def group(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        keys = rows.column("key").to_pylist()
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(len(keys), width)
        _, labels = np.unique(np.array(rows.column("label").to_pylist(), dtype=object), return_inverse=True)
        block, i, j = (np.asarray(rows.column(c)) for c in ("block", "i", "j"))
        left = np.flatnonzero(block == i[0])
        right = None if i[0] == j[0] else np.flatnonzero(block == j[0])
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()] if exact else None
        pairs = bucket_pairs(Bucket(keys, sigs, labels, rows.column("place")[0].as_py(), sets), left, right, scheme, least)
        return [(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at: tuple | None = None

        def sent(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = np.stack([np.asarray(table.column(c)) for c in ("band", "i", "j")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), table.num_rows]
            found: list = []
            for a, b in zip(edges, edges[1:]):
                if held and at != tuple(ids[:, a]):
                    found += group(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
                at = tuple(ids[:, a])
            if found:
                yield sent(found)
        if held and (found := group(pa.concat_tables(held))):
            yield sent(found)

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def full_sets(nodes: DataFrame, docs: DataFrame, signed: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, shingles) of nodes(node): the set of one of its texts as sorted 64-bit hashes."""
    need = signed.join(nodes, F.col("key") == F.col("node")).groupBy("key").agg(F.min("doc_id").alias("id"))
    texts = docs.join(need, F.col("doc_id") == F.col("id")).select("key", "text")
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])
    words = scheme.words

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = zip(part.column("key").to_pylist(), shingle_sets(part.column("text"), words))
                    good = [(want, own.tobytes()) for want, (key, own) in sets if key == want]  # an id may stand before several texts
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.binary()), pa.array([g[1] for g in good], pa.binary())], schema=schema)

    return pin(texts.mapInArrow(gather, "node binary, shingles binary").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, docs: DataFrame, signed: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, signed, scheme)
    first = pairs.join(sets, F.col("a") == F.col("node")).select("a", "b", F.col("shingles").alias("of_a"))
    both = first.join(sets, F.col("b") == F.col("node")).select("a", "b", "of_a", F.col("shingles").alias("of_b"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    percent = scheme.percent

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_of = zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs_of]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=out).filter(pa.array(good, pa.bool_()))

    return pin(both.mapInArrow(test, "a binary, b binary"))


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; a set has the distinct shingles of five, or the
    whole sequence of a shorter text. Rows link at 85 % or more of the union; component_id is the smallest id that
    links reach, kept says whether it is the row's own. Texts without words, null ones too, have an empty set and
    stand alone, as do rows without an id (component_id null, kept). Equal texts are always linked. Repeated ids
    with different texts are judged by their own texts. Other columns are not carried.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = pin(signatures(docs, scheme))
    nodes = pin(signed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first("sig").alias("sig")))
    width = 2 * scheme.rows
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width))
    bands = nodes.select("key", F.posexplode(F.array(*[band(i) for i in range(scheme.bands)])).alias("place", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = pin(bands.join(shared, "band").select("band", "place", "n", "key"))

    tested = pin(propose(members.withColumn("label", F.col("key")).join(nodes, "key"), scheme))
    links = confirmed(tested, docs, signed, scheme)
    labels = components(links)

    labelled = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    apart = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select("band")
    split = pin(labelled.join(apart, "band"))
    sets = full_sets(split.select(F.col("key").alias("node")).distinct(), docs, signed, scheme)
    more = propose(split.join(nodes, "key").join(sets.withColumnRenamed("node", "key"), "key"), scheme)
    labels = components(links.union(more))

    least = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("lowest"))
    whole = named.join(lowest, "label").select(F.col("key").alias("node"), "lowest")
    out = signed.drop("sig").join(whole, F.col("key") == F.col("node"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: one row of every component, with all its columns.

    Rows without an id and texts without words stand for themselves. Of rows with equal id and equal words one stays.
    """
    judged = near_duplicates(docs, scheme, id_col, text).filter("kept")
    chosen = judged.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).filter(F.col("_key").isNotNull()).dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("bigint").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    lowered = F.array_join(words_of(lower_ascii(F.col("_text"))), " ")
    rows = rows.withColumn("_words", F.md5(lowered.cast("binary")))
    alone = rows.filter(F.col("_doc").isNull() | (lowered == "")).select("_row.*")
    found = rows.filter(F.col("_doc").isNotNull() & (lowered != "")).join(chosen, F.col("_doc") == F.col("_id"), "left_semi")
    return found.dropDuplicates(["_doc", "_words"]).select("_row.*").unionByName(alone)
