"""Whitening against a dense eigensolver and exact integer sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import plans, whitening


@pytest.mark.parametrize("size", [1, 3, 8, 9, 20, 64, 150])
@pytest.mark.parametrize("kind", ["falling", "flat", "low rank", "equal"])
def test_eigenpairs_of_a_dense_matrix(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    place = np.arange(size)
    e = {"falling": 10.0 * 0.8**place, "flat": 1 + 0.01 * place, "low rank": np.where(place < 5, 3.0 + place, 0), "equal": np.where(place < 4, 5.0, 1.0)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors, residuals = whitening.jacobi_davidson(lambda block: a @ block, size, 8, float(np.trace(a)))
    want = np.sort(e)[::-1][: min(8, size)]
    want = want[want > 1e-12]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * np.trace(a) and residuals.max() < 1e-13 * np.trace(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def check(rows, got, k=8):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in good])
    n, s = len(x), x.sum(axis=0)
    far = ((n * x - s).astype(object) ** 2).sum(axis=1)
    centred = x - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    assert len(got) == n * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), d) for (i, _), d in zip(good, far))
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(k):
        want = centred @ q[:, c] / np.sqrt(e[c])
        have = np.array([by_id[i, c + 1]["whitened"] for i, _ in good])
        have *= np.sign(have @ want)
        assert np.abs(have - want).max() < 1e-8
    assert all(abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    df = plans.op13_jacobi_davidson_whitening(spark, folder)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, df.collect())
    # products add up in any order, so a second run on the same rows gives the same numbers
    assert df.count() == 8 * len(rows)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(10) * np.arange(1, 11)]) for i in range(120)]
    rows += [(500, None), (501, [1.0, None] * 5), (502, [float("nan")] * 10), (503, [float("inf")] + [0.0] * 9), (504, [50.0] * 4), (505, [])]
    rows += [rows[3], rows[3]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("_x", F.lit(1)).withColumn("n", F.lit("clash"))
    table.repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(rows, plans.op13_jacobi_davidson_whitening(spark, str(tmp_path)).collect())


def test_tables_without_variance(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows, n in (([], 0), ([(1, None)], 0), ([(1, [])], 1), ([(None, [1.0, 2.0])], 1), ([(i, [1.0, 2.0]) for i in range(5)], 5)):
        out = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
        assert [(r["n"], r["deviation"], list(r["whitened"])) for r in out] == [(n, 0, [])] * n
    out = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], kind)).collect()
    assert all(len(r["whitened"]) == 1 for r in out) and abs(sum(r["whitened"][0] ** 2 for r in out) / 5 - 1) < 1e-12
