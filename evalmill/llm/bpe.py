"""BPE encoding and decoding by a distinct-word table.

Texts are cut into words with the white space before them, at places where the vocabulary's own cut never joins.
A chunk of documents keeps the numbers of its words among its different ones. Only the lists of different words
meet: every distinct word of the corpus is encoded once, and its ids go back to the chunks by position. The
documents are read twice instead of being written down in between.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import bounds, pick_lists, slices
from evalmill.llm.tokens import byte_pieces, distinct, lists_encoder, tokenizer_json

#: Characters that some tables call white space, besides blank and tab to carriage return.
ODD = "\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
PLAIN_WORDS = re.compile("[\x20\t-\r]*[^\x20\t-\r]+|[\x20\t-\r]+")
SAFE_CUTS = re.compile(f"(?=[\x20\t-\r])(?<=[^\x20\t-\r{ODD}])")
HAS_ODD = re.compile(f"[{ODD}]")
CHUNK, PART = 32 << 20, 8 << 20
#: Words encoded before their ids are sent back.
FLUSH = 1 << 20


def units(text: str) -> list[str]:
    """The text in parts that are encoded alike alone and together.

    A part starts at white space behind a character that surely is none. There the vocabulary's pattern always
    starts a new token, whatever follows.
    """
    return [u for u in SAFE_CUTS.split(text) if u] if HAS_ODD.search(text) else PLAIN_WORDS.findall(text)


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: small numbers leave the upper planes empty."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Chunk:
    """Whole documents of one partition, at most CHUNK bytes of text (a longer document stands alone).

    words: the distinct words, the most frequent first, ties by word; places: the number of every word in order.
    """

    def __init__(self, number: int, parts: list[pa.RecordBatch]):
        self.number, self.ids, self.counts = number, [], []
        coded = []
        for part in parts:
            self.ids += part.column("doc_id").to_pylist()
            words: list[str] = []
            for one in part.column("text").to_pylist():
                own = units(one)
                words += own
                self.counts.append(len(own))
            coded.append(pa.array(words, pa.string()).dictionary_encode())
        whole = pa.chunked_array(coded, type=pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        known = whole.chunk(0).dictionary if whole.num_chunks else pa.array([], pa.string())
        places = np.concatenate([np.asarray(c.indices) for c in whole.chunks] or [np.zeros(0, np.int32)]).astype(np.int64)
        often = np.bincount(places, minlength=len(known))
        table = pa.table({"often": pa.array(-often), "word": known})
        order = np.asarray(pc.sort_indices(table, sort_keys=[("often", "ascending"), ("word", "ascending")])).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.places = known.take(pa.array(order)), rank[places]


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The chunks of a partition. Both passes over the documents cut them alike; see ``put_back`` for the check."""
    first, number = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", PART):
            more = int(np.asarray(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0))
            if held and size + more > CHUNK:
                yield Chunk(first + number, held)
                number, held, size = number + 1, [], 0
            held.append(part)
            size += more
    if held:
        yield Chunk(first + number, held)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (their text) of every document.

    The ids are those of the tokenizer on the whole text (null: empty) without added special tokens; special
    tokens written in a text are found. ``decoded`` looks every id up in the id-to-piece table (fixed size) and
    reads the joined bytes as UTF-8. Repeated rows come out each; other columns are not carried.
    """
    spec = tokenizer_json(tokenizer)
    piece_values, piece_ends = byte_pieces(spec)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunked(batches):
            n = len(c.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c.number)), pa.array(np.arange(n, dtype=np.int32)), c.words], names=["chunk", "pos", "word"])

    def keep_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunked(batches):
            row = (c.number, c.ids, packed(np.array(c.counts)), packed(c.places), len(c.words))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["chunk", "doc_ids", "counts", "places", "n_words"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: every distinct word is encoded once, its ids go to all chunks that hold it."""
        encode = lists_encoder(spec)
        chunks, places, lists, ends, last = [], [], [], [], None

        def send() -> pa.RecordBatch:
            chunk, pos = np.concatenate(chunks), np.concatenate(places)
            lengths = np.concatenate([np.diff(e) for e in ends])
            edges, values = bounds(lengths), np.concatenate(lists)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            homes, found = [], []
            for part in np.split(order, cuts):
                ids, _ = pick_lists(part, values, edges)
                homes.append(int(chunk[part[0]]))
                found.append((packed(pos[part]), packed(lengths[part]), packed(ids)))
            return pa.RecordBatch.from_arrays(
                [pa.array(homes, pa.int64()), *[pa.array(list(c), pa.binary()) for c in zip(*found)]], names=["home", "pos", "lengths", "ids"]
            )

        for batch in batches:
            known, index = distinct(batch.column("word"))
            if last is not None and known and known[0] == last[0]:
                values, edges = encode(known[1:])
                values, edges = np.concatenate([last[1], values]), np.concatenate([[0], edges + len(last[1])])
            else:
                values, edges = encode(known)
            if known:
                last = (known[-1], values[edges[-2] :])
            own, own_edges = pick_lists(index, values, edges)
            chunks.append(np.asarray(batch.column("chunk")))
            places.append(np.asarray(batch.column("pos")))
            lists.append(own)
            ends.append(own_edges)
            if sum(map(len, places)) >= FLUSH:
                yield send()
                chunks, places, lists, ends = [], [], [], []
        if sum(map(len, places)):
            yield send()

    def put_back(chunk: pa.Table, found: pa.Table) -> pa.Table:
        pos = np.concatenate([unpacked(x) for x in found.column("pos").to_pylist()] or [np.zeros(0, np.int64)])
        lengths = np.concatenate([unpacked(x) for x in found.column("lengths").to_pylist()] or [np.zeros(0, np.int64)])
        flat = np.concatenate([unpacked(x) for x in found.column("ids").to_pylist()] or [np.zeros(0, np.int64)]).astype("<u4")
        order = np.argsort(pos, kind="stable")
        if chunk.num_rows != 1 or len(pos) != chunk.column("n_words")[0].as_py() or (len(pos) and (pos[order] != np.arange(len(pos))).any()):
            raise ValueError("the two passes cut different chunks: the rows of the documents changed in between")
        values, ends = pick_lists(order, flat, bounds(lengths))
        places = unpacked(chunk.column("places")[0].as_py())
        edges = bounds(unpacked(chunk.column("counts")[0].as_py()))
        n_tokens, ids, decoded = [], [], []
        for a, b in zip(edges, edges[1:]):
            own, _ = pick_lists(places[a:b], values, ends)
            text, _ = pick_lists(own.astype(np.int64), piece_values, piece_ends)
            n_tokens.append(len(own))
            ids.append(own.tobytes())
            decoded.append(text.tobytes().decode("utf-8", "replace"))
        return pa.table(
            {
                "doc_id": pa.array(chunk.column("doc_ids")[0].as_py(), pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "decoded": pa.array(decoded, pa.string()),
            }
        )

    listed = rows.mapInArrow(list_words, "chunk bigint, pos int, word string").repartition("word").sortWithinPartitions("word")
    back = listed.mapInArrow(encode_words, "home bigint, pos binary, lengths binary, ids binary")
    whole = rows.mapInArrow(keep_places, "chunk bigint, doc_ids array<bigint>, counts binary, places binary, n_words bigint")
    return whole.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(put_back, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
