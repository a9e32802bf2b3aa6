"""Queries over demonstration retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import retrieve as R
from evalmill.plans import draws_sql as D
from evalmill.plans.catalog import query
from evalmill.plans.sql import round6


def tests(t):
    return t.benchmark.select(F.col("item_id").alias("test_id"), "text")


def trains(t):
    return t.documents.select(F.col("doc_id").alias("train_id"), "text")


def vectors(t, id_name):
    return t.embeddings.select(F.col("vec_id").alias(id_name), F.col("embedding").alias("vec"))


@query("c1_retrieve_none", "SELECT item_id AS test_id, CAST(0 AS BIGINT) AS demos FROM benchmark")
def _(t):
    edges = R.retrieve_none(tests(t))
    counts = tests(t).select("test_id").join(edges, "test_id", "left").groupBy("test_id")
    return counts.agg(F.count("train_id").alias("demos"))


@query("c2_retrieve_fixed", "SELECT item_id AS test_id, CAST(r AS INT) AS \"rank\", id AS train_id FROM benchmark, (VALUES (1, CAST(5 AS BIGINT)), (2, 0), (3, 17)) x(r, id)")
def _(t):
    return R.retrieve_fixed(tests(t), trains(t), [5, 0, 17])


@query("c3_retrieve_random", D.RANDOM_DEMOS)
def _(t):
    return R.retrieve_random(t.orders.select(F.col("o_orderkey").alias("test_id")), trains(t), 4)


@query("c4_retrieve_sliding", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey AS test_id, CAST(r AS INT) AS "rank", CAST(((o_orderkey - 4 + r - 1) % n + n) % n AS BIGINT) AS train_id FROM orders, n, (VALUES (1), (2), (3), (4)) x(r)""")
def _(t):
    return R.retrieve_sliding(t.orders.select(F.col("o_orderkey").alias("test_id")), 4, t.orders.count())


BM25 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS k FROM documents),
tf AS (SELECT doc_id, len(k) AS dl, t, count(*) AS f FROM (SELECT doc_id, k, unnest(k) AS t FROM d) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM d),
r AS (SELECT t, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY t, n),
i AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(c * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN i USING (t) JOIN tf USING (t), n GROUP BY 1, 2),
a AS (SELECT b.item_id, d.doc_id, round(coalesce(s, 0), 9) AS s FROM benchmark b CROSS JOIN d LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = d.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id DESC) AS k FROM a)
SELECT item_id AS test_id, CAST(k AS INT) AS "rank", doc_id AS train_id, round(s, 6) AS score FROM k WHERE k <= 5"""


@query("c5_retrieve_bm25", BM25)
def _(t):
    return round6(R.retrieve_bm25(tests(t), trains(t), 5).select("test_id", "rank", "train_id", "score"))


@query("c5_retrieve_bm25_in_blocks", BM25)
def _(t):
    found = R.retrieve_bm25(tests(t), trains(t), 5, train_block=2000)
    return round6(found.select("test_id", "rank", "train_id", "score"))


DOT = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, round(list_dot_product(a.e, b.e), 9) AS s FROM v a CROSS JOIN v b),
k AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY s DESC, train_id DESC) AS k FROM s)
SELECT test_id, CAST(k AS INT) AS "rank", train_id, round(s, 6) + 0e0 AS score FROM k WHERE k <= 4"""


@query("c6_retrieve_dense", DOT)
def _(t):
    found = R.retrieve_dense(vectors(t, "test_id"), vectors(t, "train_id"), 4)
    return round6(found.select("test_id", "rank", "train_id", "score"))


@query("c6_retrieve_dense_in_blocks", DOT)
def _(t):
    found = R.retrieve_dense(vectors(t, "test_id"), vectors(t, "train_id"), 4, test_block=256, train_block=1024)
    return round6(found.select("test_id", "rank", "train_id", "score"))


@query("c7_retrieve_diverse")
def _(t):
    return round6(R.retrieve_diverse(vectors(t, "test_id"), vectors(t, "train_id"), 5, candidates=50))


@query("c8_select_vote_k", """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
s AS (SELECT a.vec_id AS voter, b.vec_id AS cand, round(list_dot_product(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
t AS (SELECT voter, cand FROM (SELECT *, row_number() OVER (PARTITION BY voter ORDER BY s DESC, cand DESC) AS k FROM s) WHERE k <= 6),
c AS (SELECT cand, count(*) AS n FROM t GROUP BY cand), m AS (SELECT t.*, n FROM t JOIN c USING (cand)),
o AS (SELECT a.cand, b.cand AS other, a.n, count(*) AS both_ FROM m a JOIN m b ON a.voter = b.voter AND (b.n > a.n OR (b.n = a.n AND b.cand < a.cand)) GROUP BY 1, 2, 3),
k AS (SELECT cand, n FROM c WHERE cand NOT IN (SELECT cand FROM o WHERE both_ >= 0.75 * n))
SELECT cand AS train_id, true AS voted FROM k ORDER BY n DESC, cand LIMIT 12""")
def _(t):
    return R.select_vote_k(vectors(t, "train_id"), 6, 12, threshold=0.75)
