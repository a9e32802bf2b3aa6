"""Suffix deduplication against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evalmill.llm import plans, suffixes

FOLDER = "/root/testdata/sf0.001"


def brute(texts, size):
    """(n_bytes, removed spans, kept) per text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + size]) for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(b), spans, bytes(np.frombuffer(b, np.uint8)[~flags]) if len(b) else b""))
    return out


def collect(df):
    rows = [(r["row"]["n"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()]
    return [r[1:] for r in sorted(rows)]


def odd_texts(rng):
    letters = rng.choice(["ab", "abcdefgh", "aé日"])
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randrange(40, 200)) for _ in range(4)] + ["ab" * 60, "a" * 90]
    texts = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else word(rng.randrange(1, 80)) for _ in range(rng.randrange(0, 8))]
        text = "".join(parts)
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            texts.append(text[:at] + "#" + text[at + 1 :])
        texts.append(text)
    return [*texts, "", None, texts[3], texts[3], shared[0] * 3, "x" * 63, "x" * 64, "y" * 65, "z" * 500]


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("seed", [16, 64])
def test_small_windows(spark, hot, seed):
    rng = random.Random(seed + hot)
    texts = odd_texts(rng)
    table = spark.createDataFrame([(i, t, b"k", 1) for i, t in enumerate(texts)], "n int, text string, kept binary, k1 int").repartition(5)
    assert collect(suffixes.drop_repeats(table, size=64, seed=seed, hot=hot)) == brute(texts, 64)


def test_repeated_windows():
    rng = random.Random(1)
    for _ in range(30):
        segments = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(64, 90))) for _ in range(6)} | {b"ab" * 50, b"ba" * 45, b"a" * 70})
        seen = Counter(s[i : i + 64] for s in segments for i in range(len(s) - 63))
        for s, got in zip(segments, suffixes.repeated_windows(segments, 64)):
            assert got.tolist() == [seen[s[i : i + 64]] > 1 for i in range(len(s) - 63)]


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r["text"] for r in rows], 400)
    assert sum(len(s) for _, s, _ in want)
    got = plans.op12_cover_suffix_dedup(spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((r["doc_id"], n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(rows, want))


def test_a_hot_passage(spark):
    """One passage in most texts, between words of their own, and near copies."""
    rng = random.Random(3)
    word = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage, long = word(80), word(300)
    texts = [word(rng.randrange(1, 40)) + " " + passage + " " + word(rng.randrange(1, 40)) for _ in range(80)]
    texts += [long[:at] + "x" + long[at + 1 :] for at in (rng.randrange(len(long)) for _ in range(30))]
    table = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    want = brute(texts, 400)
    assert collect(suffixes.drop_repeats(table)) == want == collect(suffixes.drop_repeats(table, hot=8))


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, None), (2, "short")], "n int, text string")
    assert suffixes.drop_repeats(table.limit(0)).count() == 0
    assert collect(suffixes.drop_repeats(table)) == [(0, [], b""), (5, [], b"short")]
    with pytest.raises(ValueError):
        suffixes.drop_repeats(table, size=100)


def test_a_text_moves_once_with_its_spans(spark):
    table = spark.createDataFrame([(1, "x" * 900, b"b"), (2, None, None)], "n int, text string, body binary")
    out = suffixes.drop_repeats(table)
    top = out._jdf.queryExecution().analyzed()
    assert [f.name() for f in top.child().schema().fields()] == ["row", "spans"]
    got = sorted((r["row"]["n"], r["row"]["body"], r["n_bytes"], bytes(r["kept"])) for r in out.collect())
    assert got == [(1, b"b", 900, b""), (2, None, 0, b"")]
