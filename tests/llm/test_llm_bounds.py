"""What scoring holds and sends stays small: words by parts, compressed numbers, chunks without words."""

import random

import numpy as np
import pyarrow as pa

from evalmill.llm import scoring
from evalmill.llm.texts import split_words


def test_words_of_a_chunk_are_numbered_part_by_part(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["", None, " \n", "é日 A a"]
    seen = []
    monkeypatch.setattr(scoring, "PART", 500)
    monkeypatch.setattr(scoring, "split_words", lambda part: seen.append(sum(len(t) for t in part.to_pylist() if t)) or split_words(part))
    batches = [pa.record_batch({"text": pa.array(texts[a:b])}) for a, b in ((0, 30), (30, 84))]
    places, words, counts = scoring.numbered(batches)
    flat, want = split_words(pa.array(texts))
    assert words.take(pa.array(places)).to_pylist() == flat.to_pylist() and len(set(words.to_pylist())) == len(words)
    assert counts.tolist() == want.tolist()
    assert max(seen) <= 500 and len(seen) > 10


def test_counts_travel_compressed():
    counts = np.zeros((5000, 8))
    counts[np.arange(5000), np.arange(5000) % 8] = np.random.default_rng(1).integers(1, 4, 5000)
    held = scoring.packed(counts)
    assert np.array_equal(scoring.unpacked(held, 8), counts.astype(np.float32))
    assert len(held) < counts.size * 4 / 10
    for values in (np.zeros(0, "<i8"), np.arange(70000).astype("<u4")):
        assert np.array_equal(scoring.spread_out(scoring.squeezed(values), values.dtype.str), values)


def test_rounds_go_on_without_the_words(spark):
    texts = [(i, f"one two w{i % 7} w{i % 3}" if i % 11 else None) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("held", scoring.held_out(scoring.F.col("doc_id")))
    docs = docs.na.fill("", ["text"])
    chunks = scoring.chunk_table(docs)
    shared = scoring.share_words(chunks)
    model, rows, kept = scoring.train(chunks, shared, scoring.read_totals(chunks, shared), states=2, rounds=2)
    assert kept.columns == list(scoring.KEPT) and kept.count() == rows.select("chunk").distinct().count()
