"""Hidden Markov language model: Baum-Welch on all training documents, exact likelihoods by the scaled forward recursion.

States emit words and the end of a text. Every word has an emission of its own in every state, however rare it is, so
the table of emissions grows with the vocabulary and is never in one place: it is cut by a hash of the word into
buckets. Chunks of documents hold the rows of their own distinct words. In each round they send their expected counts
to the buckets, which add them by word and send every chunk its rows back. Only starts, moves, the emissions of the
end and one total per state reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import bounds, slices, split_words
from evalmill.session import pin

CHUNK = 12 << 20
#: Bytes of text that are split into words at a time, and rows of emissions that are made at a time.
PART, ROWS = 2 << 20, 1 << 15
#: Rows (one per chunk and distinct word) that a bucket holds on average: the number of buckets grows with the input.
BUCKET = 500_000
#: Longest training sequence; longer texts train as several, scores are never cut.
SEGMENT = 1024
LOCKSTEP = 512
CHUNKS = "chunk bigint, doc_ids array<bigint>, held array<boolean>, counts array<int>, places binary, words array<string>, n_train array<bigint>, tops binary"
KEPT = ("chunk", "doc_ids", "held", "counts", "places")
SHARED = "chunk bigint, bucket int, index binary, c binary, fresh bigint, loose double"
#: Occurrences, dealt like all tokens over the states, that are added to a word's own before its states are estimated.
KAPPA = 10.0


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def numbered(texts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a chunk as numbers of its distinct ones, these in order of their first place, and the words of each text.

    Only the words of one part are in memory as words.
    """
    indices, listed, counts = [], [], []
    for batch in texts:
        for part in slices(batch, "text", PART):
            flat, n = split_words(part.column("text"))
            coded = flat.dictionary_encode()
            indices.append(np.asarray(coded.indices, dtype=np.uint32))
            listed.append(coded.dictionary)
            counts.append(n)
    again = pa.concat_arrays(listed).dictionary_encode()
    number, ends = np.asarray(again.indices), bounds(np.array([len(x) for x in listed], dtype=np.int64))
    places = [number[a:b][x].astype(np.uint32) for a, b, x in zip(ends, ends[1:], indices)]
    return np.concatenate(places), again.dictionary, np.concatenate(counts)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def spread_out(held: bytes, kind: str) -> np.ndarray:
    width, size = np.dtype(kind).itemsize, int.from_bytes(held[:8], "little")
    planes = np.frombuffer(pa.decompress(held[8:], size * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def chunk_table(docs: DataFrame) -> DataFrame:
    """Chunks of documents(doc_id, text, held) with the places of their words among the chunk's distinct ones, written once.

    The distinct words are listed by hash, so those of a bucket stand together; ``tops`` are the hashes' leading bits.
    """
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32()))]
        + [("places", pa.binary()), ("words", pa.list_(pa.string())), ("n_train", pa.list_(pa.int64())), ("tops", pa.binary())]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                more = int(np.asarray(part.column("size")).sum())
                if parts and size + more > CHUNK:
                    yield pa.Table.from_batches(parts)
                    parts, size = [], 0
                parts.append(part)
                size += more
        if parts:
            yield pa.Table.from_batches(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(gather(batches)):
            places, dictionary, counts = numbered(rows.select(["text"]).to_batches())
            hashes = word_hashes(dictionary)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            places, dictionary = rank[places], dictionary.take(pa.array(order))
            held = np.asarray(rows.column("held").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
            n_train = np.bincount(places[np.repeat(~held, counts)], minlength=len(dictionary))
            row = (first + number, rows.column("doc_id").to_pylist(), held.tolist(), counts.tolist(), squeezed(places.astype("<u4")))
            arrays = [pa.array([v], f.type) for v, f in zip(row, schema)]
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(dictionary)], pa.int32()), dictionary.cast(pa.string())))
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(n_train)], pa.int32()), pa.array(n_train, pa.int64())))
            arrays.append(pa.array([(hashes[order] >> np.uint64(32)).astype("<u4").tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return pin(docs.withColumn("size", F.octet_length("text")).mapInArrow(cut, CHUNKS))


@dataclass
class Totals:
    """Training tokens with ends, distinct ones among them, ends, and the sum of ``loose`` over the distinct ones."""

    n_tokens: int
    n_distinct: int
    n_ends: int
    loose: float

    @property
    def whole(self) -> float:
        return self.n_tokens + 0.5 * (self.n_distinct + 1)

    def base(self, counts):
        """Smoothed unigram probability of words of these training counts; what is left is that of one unseen word."""
        return (counts + 0.5) / self.whole


def loose(counts):
    """The part of a word's occurrences that is dealt over the states like all tokens: nearly all of a rare word's."""
    return counts * KAPPA / (counts + KAPPA)


def share_words(chunks: DataFrame) -> DataFrame:
    """(chunk, bucket, index, c, fresh, loose): for a chunk's words of a bucket, by hash, their rows in the bucket and training counts.

    A word stands at most once per chunk, and a bucket has one row per chunk. ``fresh`` counts the bucket's words with
    training tokens and ``loose`` sums theirs, on one of its rows.
    """
    pairs = chunks.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    bits = min(31, max(6, (pairs // BUCKET).bit_length()))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("n_train", pa.list_(pa.int64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, n_train = batch.column("words")[i].values, batch.column("n_train")[i].values
                bucket = (np.frombuffer(batch.column("tops")[i].as_py(), "<u4") >> np.uint32(32 - bits)).astype(np.int32)
                used, first = np.unique(bucket, return_index=True)
                ends = pa.array(np.append(first, len(words)), pa.int32())
                chunk = pa.array(np.full(len(used), batch.column("chunk")[i].as_py()), pa.int64())
                lists = [pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, n_train)]
                yield pa.RecordBatch.from_arrays([chunk, pa.array(used, pa.int32()), *lists], schema=schema)

    def count(rows: pa.Table) -> pa.Table:
        lists = rows.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        index = np.asarray(coded.indices, dtype=np.int64)
        c = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(c, index, np.asarray(rows.column("n_train").combine_chunks().flatten()))
        edges = bounds(np.asarray(lists.value_lengths(), dtype=np.int64))
        spans = list(zip(edges, edges[1:]))
        return pa.table(
            {
                "chunk": rows.column("chunk"),
                "bucket": rows.column("bucket"),
                "index": pa.array([squeezed(index[a:b].astype("<u4")) for a, b in spans], pa.binary()),
                "c": pa.array([squeezed(c[index[a:b]].astype("<i8")) for a, b in spans], pa.binary()),
                "fresh": pa.array([int((c > 0).sum()) if n == 0 else 0 for n in range(len(spans))], pa.int64()),
                "loose": pa.array([float(loose(c).sum()) if n == 0 else 0.0 for n in range(len(spans))], pa.float64()),
            }
        )

    dealt = chunks.select("chunk", "words", "n_train", "tops").mapInArrow(deal, "chunk bigint, bucket int, words array<string>, n_train array<bigint>")
    return pin(dealt.groupBy("bucket").applyInArrow(count, SHARED))


def read_totals(chunks: DataFrame, shared: DataFrame) -> Totals:
    in_chunk = F.aggregate("n_train", F.lit(0).cast("bigint"), lambda a, b: a + b)
    found = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("ends"), F.sum(in_chunk).alias("n")).first()
    ends = found["ends"] or 0
    words = shared.agg(F.sum("fresh").alias("n"), F.sum("loose").alias("loose")).first()
    return Totals((found["n"] or 0) + ends, (words["n"] or 0) + (ends > 0), ends, (words["loose"] or 0.0) + loose(ends))


@dataclass
class Hmm:
    """start (K), moves (K, K) and emits (symbols, K); rows of start and moves and columns of emits sum to one."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def lockstep(lengths: np.ndarray, size: int = LOCKSTEP) -> Iterator[np.ndarray]:
    """Sequences of like length together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), size):
        yield order[at : at + size]


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of every sequence; states are carried on, nothing is cut."""
    lengths = np.array([len(x) for x in sequences])
    out = np.zeros(len(sequences))
    for group in lockstep(lengths):
        longest = lengths[group]
        flat = np.concatenate([sequences[i] for i in group])
        starts = bounds(longest)[:-1]
        active = np.searchsorted(-longest, -np.arange(longest[0]), side="left")  # sequences longer than t
        logs = np.zeros(len(group))
        state = np.broadcast_to(model.start, (len(group), len(model.start)))
        for t in range(longest[0]):
            n = active[t]
            state = (state[:n] if t == 0 else state[:n] @ model.moves) * model.emits[flat[starts[:n] + t]]
            scale = state.sum(axis=1)
            state = state / scale[:, None]
            logs[:n] += np.log10(scale)
        out[group] = logs
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums over sequences: starts, moves and emissions."""
    k = len(model.start)
    starts_sum, moves_sum = np.zeros(k), np.zeros((k, k))
    emits_sum = np.zeros((k, len(model.emits)))  # by state, so that a state's are added in one run of memory
    emits, moves = model.emits.astype(np.float32, copy=False), model.moves.astype(np.float32)
    ones, back = np.ones((k, 1), np.float32), np.ascontiguousarray(moves.T)
    lengths = np.array([len(x) for x in sequences])
    for group in lockstep(lengths):
        longest = lengths[group]
        flat = np.concatenate([sequences[i] for i in group])
        starts = bounds(longest)[:-1]
        steps = int(longest[0])
        active = np.searchsorted(-longest, -np.arange(steps), side="left")
        alphas: list = []
        scaled: list = []
        symbols = []
        state = None
        for t in range(steps):
            n = active[t]
            symbols.append(flat[starts[:n] + t])
            seen = emits[symbols[t]]
            state = (model.start.astype(np.float32) if state is None else state[:n] @ moves) * seen
            scale = 1 / (state @ ones)  # a product, as sums over short rows are slow
            state *= scale
            seen *= scale
            alphas.append(state)
            scaled.append(seen)
        after = None
        gammas: list = [None] * steps
        for t in range(steps - 1, -1, -1):
            n = active[t]
            beta = np.ones((n, k), np.float32)
            if after is not None:
                m = len(after)
                moves_sum += (alphas[t][:m].T @ after) * model.moves
                beta[:m] = after @ back
            gamma = alphas[t] * beta
            gammas[t] = gamma / (gamma @ ones)  # step by step: on one large product the library's threads would spin
            after = scaled[t] * beta
            alphas[t] = scaled[t] = None
        starts_sum += gammas[0].sum(axis=0)
        weights, symbol = np.concatenate(gammas), np.concatenate(symbols).astype(np.intp)
        del gammas, symbols
        for j in range(k):
            emits_sum[j] += np.bincount(symbol, weights=weights[:, j], minlength=len(model.emits))
    return starts_sum, moves_sum, emits_sum.T


@dataclass
class Model:
    """What the driver holds of the model: start (K), moves (K, K), end (K) and how a word's emissions are made.

    At first they are ``weight`` times the smoothed unigram, and ``guess`` for some words. Later ``scale`` times a
    word's own counts per state, as far as they are not loose, plus ``weight`` for each loose one and for the half
    occurrence that the unigram adds.
    """

    start: np.ndarray
    moves: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    scale: np.ndarray | None
    guess: dict[str, np.ndarray]

    def needs(self) -> list[str]:
        """Columns of a chunk: its words only where some of them are looked up."""
        return [*KEPT, *(["words"] if self.guess else [])]


def packed(counts: np.ndarray) -> bytes:
    """Counts to a 65,536th of an occurrence, by state, compressed, so that what is clear takes little."""
    return squeezed(np.rint(counts.T * 65536.0).astype("<f4").ravel())


def unpacked(held: bytes, states: int) -> np.ndarray:
    return spread_out(held, "<f4").reshape(states, -1).T / np.float32(65536.0)


def clean_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files out of use, which it does when the driver's garbage collector meets their owner.

    Without it that may be long after a round, and the next one's files come on top.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete the files of a pinned table that a later one has replaced."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Chunk:
    """One chunk with the training counts of its words and the counts per state, as the buckets have sent them."""

    def __init__(self, chunk: pa.Table, rows: pa.Table, states: int):
        held = {n: chunk.column(n)[0] for n in chunk.column_names}
        self.number = held["chunk"].as_py()
        self.words = held["words"].values if "words" in held else None
        self.held = np.array(held["held"].as_py(), dtype=bool)
        self.edges = bounds(np.array(held["counts"].as_py(), dtype=np.int64))
        self.places = spread_out(held["places"].as_py(), "<u4")
        self.doc_ids = held["doc_ids"].as_py()
        rows = rows.sort_by("bucket")
        self.buckets = rows.column("bucket").to_pylist()
        parts = [spread_out(x, "<i8") for x in rows.column("c").to_pylist()]
        self.cuts = bounds(np.array([len(x) for x in parts], dtype=np.int64))
        self.c = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sums = np.zeros((len(self.c), states), np.float32)
        if "sums" in rows.column_names:
            for a, b, sums in zip(self.cuts, self.cuts[1:], rows.column("sums").to_pylist()):
                self.sums[a:b] = unpacked(sums, states)

    def hmm(self, model: Model, totals: Totals, kind: type = float) -> Hmm:
        """The model for this chunk: symbol 0 is the end, symbol 1 + i its i-th distinct word."""
        emits = np.empty((1 + len(self.c), len(model.end)), kind)
        emits[0] = model.end
        for a in range(0, len(self.c), ROWS):
            c = self.c[a : a + ROWS]
            if model.scale is not None:
                made = self.sums[a : a + ROWS].astype(float)
                made *= (c / (c + KAPPA))[:, None]
                made *= model.scale
                made += np.outer(loose(c) + 0.5, model.weight)
            else:
                made = np.outer(totals.base(c), model.weight)
                for i, w in enumerate(self.words.slice(a, ROWS).to_pylist()):
                    if w in model.guess:
                        made[i] += model.guess[w]
            emits[1 + a : 1 + a + ROWS] = made
        return Hmm(model.start, model.moves, emits)

    def sequence(self, i: int) -> np.ndarray:
        return np.append(self.places[self.edges[i] : self.edges[i + 1]] + np.uint32(1), np.uint32(0))

    def segments(self) -> list[np.ndarray]:
        """The training sequences."""
        out = []
        for i in np.flatnonzero(~self.held):
            whole = self.sequence(i)
            out += [whole[a : a + SEGMENT] for a in range(0, len(whole), SEGMENT)]
        return out


def first_guess(chunks: DataFrame, shared: DataFrame, totals: Totals, states: int, seed: int = 3) -> Model:
    """Emissions half the unigram, half one of a few texts that differ most: only the start of the iterations.

    The texts are 16 per state, drawn by a hash, each up to its first training sequence.
    """
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "held")).alias("pos", "at")).filter("not at.held")
    drawn = [(r["chunk"], r["pos"]) for r in listed.orderBy(F.xxhash64(F.lit(seed), "at.doc_ids"), "chunk", "pos").limit(16 * states).select("chunk", "pos").collect()]
    of_chunk: dict[int, list[int]] = {}
    for chunk, pos in drawn:
        of_chunk.setdefault(chunk, []).append(pos)

    def read(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        whole, out = Chunk(chunk, rows, states), []
        for pos in of_chunk[whole.number]:
            seen, n = np.unique(whole.sequence(pos)[:SEGMENT], return_counts=True)
            out += [(whole.number, pos, None if i == 0 else whole.words[int(i) - 1].as_py(), 0 if i == 0 else int(whole.c[i - 1]), int(k)) for i, k in zip(seen, n)]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(list(v), t) for n, v, t in zip(("chunk", "pos", "word", "c", "n"), zip(*out), types)})

    found = []
    if drawn:
        here = F.col("chunk").isin(list(of_chunk))
        both = chunks.drop("n_train", "tops").filter(here).groupBy("chunk").cogroup(shared.filter(here).select("chunk", "bucket", "c").groupBy("chunk"))
        found = both.applyInArrow(read, "chunk bigint, pos bigint, word string, c bigint, n bigint").collect()
    counts = {r["word"]: r["c"] for r in found} | {None: totals.n_ends}
    row = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (w is not None, w or "")))}
    known = np.array([totals.base(counts[w]) for w in row])
    # words outside the drawn texts have the same ratio in all of them, so they stand together at the end
    unigram = np.append(known, max(1 - known.sum(), 1e-12))
    texts = {at: np.zeros(len(unigram)) for at in drawn}
    for r in found:
        texts[r["chunk"], r["pos"]][row[r["word"]]] = r["n"]
    mixed = [0.5 * t / t.sum() + 0.5 * unigram for t in texts.values()]
    chosen, last = [], unigram
    far = np.full(len(mixed), np.inf)
    while mixed and len(chosen) < states - 1:
        far = np.minimum(far, [float((m * np.log(m / last)).sum() + (last * np.log(last / m)).sum()) for m in mixed])
        chosen.append(mixed[int(far.argmax())])
        last = chosen[-1]
    weight = np.array([1.0] + [0.5] * len(chosen) + [1.0] * (states - 1 - len(chosen)))
    more = np.zeros((len(unigram), states))
    for j, m in enumerate(chosen):
        more[:, j + 1] = m - 0.5 * unigram
    stay = 0.95
    moves = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(moves, stay if states > 1 else 1.0)
    guess = {w: more[i] for w, i in row.items() if w is not None}
    return Model(np.full(states, 1 / states), moves, weight * totals.base(totals.n_ends) + more[row[None]], weight, None, guess)


def expect(chunks: DataFrame, rows: DataFrame, model: Model, totals: Totals, states: int) -> DataFrame:
    """One round's expected counts: (chunk, bucket, counts) of a chunk's words, and in rows with a negative bucket the
    sums s0, s1, ... of moves (-K to -1), starts, ends, all tokens and those that are not loose."""
    names = [f"s{i}" for i in range(states)]
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), *[(n, pa.float64()) for n in names]])

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        whole = Chunk(chunk, rows, states)
        sequences = whole.segments()
        if not sequences:
            return schema.empty_table()
        start, moves, emits = expected_counts(whole.hmm(model, totals, np.float32), sequences)
        sent = emits[1:]
        counts = [packed(sent[a:b]) for a, b in zip(whole.cuts, whole.cuts[1:])]
        c = np.append(totals.n_ends, whole.c)
        small = np.vstack([moves, start, emits[0], emits.sum(axis=0), (c / (c + KAPPA)) @ emits])
        keys = [*range(-states, 0), *[-i - states for i in (1, 2, 3, 4)]]
        values = np.vstack([np.zeros((len(counts), states)), small])
        columns = [[whole.number] * len(values), [*whole.buckets, *keys], [*counts, *[None] * len(keys)], *values.T]
        return pa.table([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    kept = chunks.select(*model.needs())
    return pin(kept.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(run, "chunk bigint, bucket int, counts binary, " + ", ".join(f"{n} double" for n in names)))


def add_counts(expected: DataFrame, shared: DataFrame, states: int) -> DataFrame:
    """(chunk, bucket, c, sums): the chunks' expected counts added by word, sent back to every chunk that has the word."""

    def add(sent: pa.Table, rows: pa.Table) -> pa.Table:
        index = {r: spread_out(x, "<u4") for r, x in zip(rows.column("chunk").to_pylist(), rows.column("index").to_pylist())}
        sums = np.zeros((1 + max(int(x.max()) for x in index.values()), states))
        # a chunk has a word once, so no row is added twice in one step; chunks in order, for the same sums in every run
        for chunk, counts in sorted(zip(sent.column("chunk").to_pylist(), sent.column("counts").to_pylist())):
            sums[index[chunk]] += unpacked(counts, states)
        back = pa.array([packed(sums[index[r]]) for r in rows.column("chunk").to_pylist()], pa.binary())
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "c": rows.column("c"), "sums": back})

    sent = expected.filter("bucket >= 0").select("chunk", "bucket", "counts")
    known = shared.select("chunk", "bucket", "index", "c")
    return sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(add, "chunk bigint, bucket int, c binary, sums binary")


def train(chunks: DataFrame, shared: DataFrame, totals: Totals, states: int = 8, rounds: int = 6) -> tuple[Model, DataFrame, DataFrame]:
    """Baum-Welch over all training rows: the model, the rows with the counts that its emissions need, and the chunks.

    The first round looks up words; it is the last to do so, and after it the chunks are kept without them.

    Of a word seen c times, KAPPA parts in c + KAPPA are dealt over the states like all tokens and the others as they
    were found, so few occurrences say little and a word that was never seen has about its unigram share in every state.
    """
    model, rows = first_guess(chunks, shared, totals, states), shared.select("chunk", "bucket", "c")
    names, last = [f"s{i}" for i in range(states)], None
    for _ in range(rounds):
        expected = expect(chunks, rows, model, totals, states)
        added = {r["bucket"]: np.array([r[n] for n in names]) for r in expected.filter("bucket < 0").groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect()}
        if last is not None:
            release(last)
        elif added:
            whole, chunks = chunks, pin(chunks.select(*KEPT))
            release(whole)
        clean_shuffles(chunks)
        if not added:
            break
        last = expected
        rows = add_counts(expected, shared, states)
        moves = np.array([added[i - states] for i in range(states)]) + 0.1
        start, ends, tokens, firm = (added[-i - states] for i in (1, 2, 3, 4))
        share = (tokens + 0.1) / (tokens + 0.1).sum()
        scale = 1 / (firm + share * (totals.loose + 0.5 * (totals.n_distinct + 1)))
        end = (ends * totals.n_ends / (totals.n_ends + KAPPA) + share * (loose(totals.n_ends) + 0.5)) * scale
        model = Model((start + 0.1) / (start + 0.1).sum(), moves / moves.sum(axis=1, keepdims=True), end, share * scale, scale, {})
    return model, rows, chunks


def score_documents(docs: DataFrame, states: int = 8, rounds: int = 6, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end. A null text is an empty one: its end alone.
    Training rows are those not held out (see ``held_out``); repeated rows count each time. Scores are log10 of the
    probability of the whole text: ``base_score`` under smoothed unigrams, ``score`` under the model, in which a word
    that was never seen has what the states leave for one such word. Without training rows the model is its prior.
    """
    ids = F.col(f"`{id_col}`")
    rows = docs.select(ids.cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), held_out(ids).alias("held"))
    chunks = chunk_table(rows)
    shared = share_words(chunks)
    totals = read_totals(chunks, shared)
    clean_shuffles(chunks)
    model, rows, chunks = train(chunks, shared, totals, states, rounds)

    def score(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        whole = Chunk(chunk, rows, states)
        base, known = np.log10(totals.base(whole.c)), whole.c > 0
        of_base, of_known = base[whole.places], known[whole.places]
        end_base = np.log10(totals.base(totals.n_ends))
        spans = list(zip(whole.edges, whole.edges[1:]))
        return pa.table(
            {
                "doc_id": pa.array(whole.doc_ids, pa.int64()),
                "held_out": pa.array(whole.held, pa.bool_()),
                "n_tokens": pa.array([b - a + 1 for a, b in spans], pa.int64()),
                "n_known": pa.array([int(of_known[a:b].sum()) + (totals.n_ends > 0) for a, b in spans], pa.int64()),
                "base_score": pa.array([float(of_base[a:b].sum() + end_base) for a, b in spans], pa.float64()),
                "score": pa.array(forward(whole.hmm(model, totals), [whole.sequence(i) for i in range(len(spans))]), pa.float64()),
            }
        )

    kept = chunks.select(*model.needs())
    out = kept.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
