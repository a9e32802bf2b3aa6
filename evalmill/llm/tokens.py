"""Tokenizers in tasks: the file is read once by the driver and travels with the function (a few MB, fixed)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Characters of which every Unicode table says the same: ASCII and the letters of Latin-1.
COMMON = re.compile("[\x20-\x7e\t-\rÀ-ÖØ-öø-ÿ]*")
LATIN = "a-zß-öø-ÿ"
LOWER_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\\s{LATIN}0-9]+")
BYTE_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def lists_encoder(spec: str) -> Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from strings to their ids: flat values and the bounds of every list. To be called inside a task.

    Strings of common characters take the merge table alone, others the whole tokenizer; the ids are the same.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = json.loads(spec)
    special = [t["content"] for t in held["added_tokens"]]
    quick = merge_table(held)
    whole: list = []

    def slow(texts: list[str]) -> list[list[int]]:
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_str(spec))
            whole[0].no_truncation()
            whole[0].no_padding()
        return [e.ids for e in whole[0].encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        common = COMMON.fullmatch
        ids = [quick(t) if quick and common(t) and not any(x in t for x in special) else None for t in texts]
        rest = [i for i, one in enumerate(ids) if one is None]
        for i, one in zip(rest, slow([texts[i] for i in rest]) if rest else ()):
            ids[i] = one
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(ends[-1])), ends

    return encode


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_table(held: dict) -> Callable[[str], list[int]] | None:
    """The merges of a vocabulary as ranks of byte strings, where ids grow in the order of the merges; else None.

    A word end becomes the byte 0xFF, which no text holds; it joins the last byte before any other merge.
    """
    import tiktoken

    model, end = held["model"], held["model"].get("end_of_word_suffix") or ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if model["type"] != "BPE" or order != sorted(order) or model.get("dropout") or model.get("byte_fallback"):
        return None
    byte_of = byte_alphabet()

    def raw(piece: str) -> bytes:
        tail = b"\xff" if end and piece.endswith(end) else b""
        return bytes(byte_of[c] for c in piece.removesuffix(end if tail else "")) + tail

    special = {t["content"] for t in held["added_tokens"]}
    ranks = {raw(p): i for p, i in model["vocab"].items() if p not in special}
    cut = held.get("pre_tokenizer") or {}
    if not end and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not held.get("normalizer"):
        return tiktoken.Encoding("own", pat_str=BYTE_PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    steps = [n["type"] for n in (held.get("normalizer") or {}).get("normalizers", [])]
    split = next((p for p in cut.get("pretokenizers", []) if p["type"] == "Split"), {})
    if end and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_SPLIT}:
        single = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return lambda text: [i for part in LOWER_PARTS.findall(text.lower()) for i in single(part.encode() + b"\xff")]
    return None


def byte_pieces(spec: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table of a byte-level vocabulary: all pieces' bytes and the bounds of every id's piece."""
    held = json.loads(spec)
    if (held.get("decoder") or {}).get("type") != "ByteLevel" or held.get("normalizer"):
        raise ValueError("needs a byte-level vocabulary without a normalizer")
    byte_of = byte_alphabet()
    pieces = {i: p for p, i in held["model"]["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
    table = []
    for i in range(max(pieces) + 1):
        piece = pieces.get(i, "")
        table.append(bytes(map(byte_of.__getitem__, piece)) if all(c in byte_of for c in piece) else piece.encode())
    ends = np.concatenate([[0], np.cumsum([len(p) for p in table])]).astype(np.int64)
    return np.frombuffer(b"".join(table), dtype=np.uint8), ends


def distinct(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different strings of an array and the number of each place's string among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
