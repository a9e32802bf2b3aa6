"""Periodic runs against a search over every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evalmill.llm import periods, plans


def every_run(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def odd_words(rng):
    """Nested repeats, Fibonacci words, abutting stretches of one period, plain random words."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(rng.choice([2, 3, 8])) for _ in range(rng.randrange(0, 150))]
    if kind == 1:
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(3, 10)):
            a, b = b, b + a
        return b[: rng.randrange(1, 160)]
    out = []
    while len(out) < 100:
        root = [rng.randrange(2) for _ in range(rng.randrange(1, 7))]
        stretch = (root * 40)[: rng.randrange(1, 50)]
        out += stretch * rng.choice([1, 1, 2, 3]) if kind < 4 else stretch
        if rng.random() < 0.3:
            out.append(rng.randrange(3))
    if kind == 5:
        half = [0, 1] * rng.randrange(3, 40) + [0]
        return [2] * rng.randrange(2) + [1] * rng.randrange(2) + half + half + [rng.randrange(3)]
    return out[:200]


@pytest.mark.parametrize("small", [2, 5, 11, 47])
@pytest.mark.parametrize("least", [2, 12])
def test_all_runs_are_found(small, least):
    rng = random.Random(small * 100 + least)
    for _ in range(40):
        docs = [odd_words(rng) for _ in range(rng.randrange(1, 7))]
        counts = np.array([len(d) for d in docs])
        flat = np.array([w for d in docs for w in d], dtype=np.int64)
        doc, (start, end, period) = periods.find_runs(flat, counts, least, small)
        got = [[] for _ in docs]
        for d, s, e, q in zip(doc, start, end, period):
            got[d].append((s, e - s, q))
        assert got == [every_run(d, least) for d in docs]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = every_run(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), digest, hashlib.sha256(left).hexdigest())


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    phrase = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"v{x}" for x in odd_words(rng)), "c", 1) for i in range(150)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, " \t\n ", "x", 1), (203, "a\x1cb　c " * 9, "x", 1), (204, (phrase + " ") * 3 + "end", "x", 1)]
    rows += [(205, "na na " * 40, "x", 1), (205, "na na " * 40, "x", 1), (206, (phrase + " z\n") * 90, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.op11_sync_set_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(expected(i, t) for i, t, *_ in rows)


def test_empty_table_and_null_ids(spark, tmp_path):
    table = spark.createDataFrame([(None, "a b " * 12)], "doc_id bigint, text string")
    for name, rows in (("some", table), ("none", table.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = plans.op11_sync_set_runs(spark, f"{tmp_path}/{name}").collect()
        assert [(r["doc_id"], r["n_runs"], r["period"]) for r in got] == ([(None, 1, 2)] if name == "some" else [])
