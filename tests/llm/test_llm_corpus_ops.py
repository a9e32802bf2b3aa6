"""Scoring, BPE, packing, near duplicates, sharding, top-k and the pipeline against brute force on small tables."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evalmill.llm import neardup, packing, scoring, sharding, topk
from evalmill.llm.bpe import round_trip
from evalmill.llm.texts import salted_rank

FOLDER = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "a  b  c  d\x1c e", "x <|endoftext|> y<|endoftext|>", "it's 12 naïve  \n\n tabs\t\tend  ", "日本語 テスト　全角 12a3", "é Σίσυφος ΣΑΣ",
    "\U0001f600 ok‍!", "<|startoftext|>abc <|endoftext|>", "!\x1c\x1d ?\x85 q", "word " * 6000, "word " * 6000, "don't we'll 3.5% a_b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(ODD)] + [(None, "no id", 1, "c"), (3, "same id", 1, "c")]
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("size"), F.lit("c").alias("word"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, size int, word string").unionByName(given).cache()


def test_bpe_round_trip(docs):
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in round_trip(docs, BYTES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert round_trip(docs.limit(0), BYTES).count() == 0


def test_packing(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r["doc_id"], n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack_documents(docs, WORDS).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(held)))
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    random.seed(2)
    limits = packing.Limits(100, 4, 4000)
    histogram = {n: random.randint(1, 30) for n in random.sample(range(1, 64), 25)}
    used, ranks = {}, {n: 0 for n in histogram}
    for length, first, last, bin_, per, base in packing.plan_bins(histogram, limits, rule=rule):
        assert first == ranks[length]
        ranks[length] = last
        for k in range(last - first):
            used.setdefault(bin_ + k // per, []).append((base + (k % per) * length, length))
    assert ranks == histogram
    for held in used.values():
        held.sort()
        assert [a for a, _ in held] == list(itertools.accumulate([0, *[n for _, n in held]]))[:-1]
        assert sum(n for _, n in held) <= 100 and len(held) <= 4 and sum(n * n for _, n in held) <= 4000


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "").replace("\x1d", "")
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0]):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i) if i is not None else None
    return [(i, len(sets[n]), least[find(n)], least[find(n)] == i) for n, (i, _) in enumerate(rows)]


def test_near_duplicates(spark, docs):
    random.seed(5)
    base = [f"w{random.randint(0, 400)}" for _ in range(120)]
    copies = []
    for n in range(60):
        own = list(base)
        for _ in range(n % 9):
            own[random.randrange(120)] = f"x{random.randint(0, 9)}"
        copies.append((5000 + n, " ".join(own)))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id bigint, text string"))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = [tuple(r) for r in neardup.near_duplicates(table).drop("key").collect()]
    assert sorted(got, key=str) == sorted(groups(rows), key=str)
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == ["doc_id", "text"]
    assert kept.count() == sum(g[3] for g in groups(rows))
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_blocks_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = [(n, " ".join(f"a{i}" for i in range(60)) + f" end{n}") for n in range(30)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_pruning_follows_the_posterior():
    least = neardup.Scheme().least_matches()
    assert (np.diff(least) > 0).all() and least[-1] < 0.85 * 252 and (1 - 0.85**7) ** 36 < 1e-6


@pytest.mark.parametrize("n", [1, 5, 40, 700])
def test_smallest_capacity(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "SUMS", 128)
    random.seed(n)
    held = sorted({random.getrandbits(64) - (1 << 63): random.choice([1, 5, random.randint(1, 3000)]) for _ in range(n)}.items())
    cuts, capacity = sharding.cut_hashes(spark.createDataFrame(held, "key bigint, size bigint"), 16)
    sizes = [s for _, s in held]
    assert capacity == sharding.smallest_capacity(sizes, 16) and (capacity == max(sizes) or sharding.fits(sizes, capacity - 1, 16) is None)
    starts = sharding.fits(sizes, capacity, 16)
    assert [sum(c <= k for c in cuts) for k, _ in held] == [sum(s <= i for s in starts[1:]) for i in range(len(held))]


def test_shards(docs):
    rows = sharding.shard_documents(docs, 16).collect()
    assert len(rows) == docs.count() and {r["_size"] for r in rows if r["text"] is None} == {1}
    by_text, slots, load = {}, {}, {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["_shard"])
        slots.setdefault(r["_shard"], []).append(r["_slot"])
        load[r["_shard"]] = load.get(r["_shard"], 0) + r["_size"]
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["_size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_ranks_are_gapless_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"))
    out = salted_rank(df, ["g"], F.xxhash64("id"), [F.col("id")], 5000).groupBy("g").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("n"), F.count("*").alias("m"))
    assert out.filter("a <> 0 or b <> n - 1 or n <> m").count() == 0


@pytest.mark.parametrize("sizes", [(16, 2), (16384, 1024)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", sizes[1])
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.normal(size=6).round(1) * 0.3]) for n in range(150)]
    rows = [(n, rows[0][1] if n % 3 == 0 else v) for n, v in rows]
    table = spark.createDataFrame([*rows, (1000, None), (1020, [1.0, None]), (1040, [float("inf")])], "vec_id bigint, embedding array<double>")
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    want = set()
    for q in range(0, 150, 20):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(150), -scores)) if i != q][:20]
        want |= {(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(table, table.filter("vec_id % 20 = 0")).collect()} == want
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_forward_is_exact_and_sums_to_one():
    rng = np.random.default_rng(0)
    model = scoring.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.3, 0.5], [0.5, 0.1], [0.2, 0.4]]))

    def direct(x):
        total = 0.0
        for z in itertools.product(range(2), repeat=len(x)):
            p = model.start[z[0]] * model.emits[x[0], z[0]]
            for a, b, y in zip(z, z[1:], x[1:]):
                p *= model.moves[a, b] * model.emits[y, b]
            total += p
        return total

    seqs = [np.array([*rng.integers(1, 3, n), 0], "<u2") for n in range(8)]
    assert np.allclose(10 ** scoring.forward(model, seqs), [direct(x) for x in seqs])
    every = [np.array([*x, 0], "<u2") for n in range(14) for x in itertools.product((1, 2), repeat=n)]
    assert 0.98 < (10 ** scoring.forward(model, every)).sum() < 1


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 5, n).astype("<u2") for n in (3, 9, 1, 30, 30)]
    emits = rng.random((5, 3))
    model = scoring.Hmm(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), emits / emits.sum(axis=0))
    last = -np.inf
    for _ in range(8):
        now = scoring.forward(model, seqs).sum()
        assert now >= last - 1e-4
        last = now
        start, moves, counts = scoring.expected_counts(model, seqs)
        assert np.isclose(counts.sum(), sum(map(len, seqs)), rtol=1e-4) and np.isclose(start.sum(), len(seqs), rtol=1e-4)
        model = scoring.Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), counts / counts.sum(axis=0))


def test_scores(spark, docs):
    import math
    from collections import Counter

    rows = [(r["doc_id"], [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or "")) if w] + [" "]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in rows
    )
    scored = scoring.score_documents(docs, rounds=2).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scored) == want
    fresh = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh) and all(r["score"] < 0 for r in scored)
    assert scoring.score_documents(docs.limit(0)).count() == 0


def test_pipeline(spark):
    """Every stage against a plain reading of its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], FOLDER).cache())
    given, good, single, clean, packed = steps
    assert good.columns == single.columns == clean.columns == given.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good.collect()}
    long = {r["doc_id"] for r in given.collect() if len((r["text"] or "").split()) >= 50}
    assert not [i for i, q in labels.items() if q == 0 and i in left] and not [i for i, q in labels.items() if q == 1 and i in long and i not in left]
    assert {r["doc_id"] for r in single.collect()} == {g[0] for g in groups([(r["doc_id"], r["text"]) for r in good.collect()]) if g[3]}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and ("[SECRET]" in r["text"] or r["text"] == before[r["doc_id"]])
    tokenizer = Tokenizer.from_file(WORDS)
    lengths = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean.collect()}
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == lengths
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, packed.collect()))
