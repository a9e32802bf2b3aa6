"""Text overlap metrics built on bags of tokens and n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalmill.functions.text import words
from evalmill.operators.ordering import dealt


def bag_counts(df: DataFrame, keys: Sequence[str], bags: dict[str, Column]) -> DataFrame:
    """How often each token ``t`` is in each bag (token array) of a key.

    ``keys`` identify a row. The texts move once, by key; the exploded tokens of
    all bags are then counted where they are, without a join or a further
    shuffle. Every key also has a null token with zero counts, so rows without
    tokens stay.
    """

    def tagged(tokens: Column, which: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(which).alias("which")))

    nothing = F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(-1).alias("which")))
    every = F.concat(nothing, *[tagged(c, i) for i, c in enumerate(bags.values())])
    tokens = df.repartition(*keys).select(*keys, F.explode(every).alias("_x")).select(*keys, "_x.*")
    return tokens.groupBy(*keys, "t").agg(*[F.count_if(F.col("which") == i).alias(n) for i, n in enumerate(bags)])


def _per_key(df: DataFrame, keys: Sequence[str], values: dict[str, Column], schema: str, measure) -> DataFrame:
    """``measure(rows)`` for every key: ``rows`` are the value tuples of all rows of the key, result rows fit ``schema``.

    The columns of ``df`` move once, by key, and lie in key order: a task holds the values of one
    key besides its batch, and no token leaves its row.
    """
    rows = dealt(df, keys).sortWithinPartitions(*keys).select(*keys, *[v.alias(n) for n, v in values.items()])
    kinds = rows.select(*keys).schema
    for field in StructType.fromDDL(schema):
        kinds = kinds.add(field)
    target = to_arrow_schema(kinds)

    def run(batches):
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for this, *row in zip(zip(*columns[: len(keys)]), *columns[len(keys) :]):
                if this != key:
                    out += [(*key, *m) for m in measure(held)] if held else []
                    key, held = this, []
                held.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in out], schema=target)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, (*key, *m))) for m in measure(held)], schema=target)

    return rows.mapInArrow(run, kinds)


def bag_overlap(df: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Multiset overlap ``both`` and sizes ``n_a``, ``n_b`` of two token arrays per key; rows without an array are left out."""

    def measure(rows):
        rows = [(x, y) for x, y in rows if x is not None and y is not None]
        left, right = Counter(t for x, _ in rows for t in x), Counter(t for _, y in rows for t in y)
        return [((left & right).total(), left.total(), right.total())] if rows else []

    return _per_key(df, keys, {"_a": a, "_b": b}, "both bigint, n_a bigint, n_b bigint", measure)


def f1_of() -> Column:
    """F1 from ``both``, ``n_a`` and ``n_b``."""
    return F.when(F.col("both") > 0, 2.0 * F.col("both") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0)


def ngram_overlap(
    df: DataFrame, keys: Sequence[str], pred: Column, refs: Column, orders: Sequence[int] = (1, 2, 3, 4)
) -> DataFrame:
    """Per key and n: ``matched`` (clipped by the best reference), ``n_pred``, ``n_ref`` (first reference).

    ``refs`` is an array of token arrays, as many as a row has. ``keys`` identify a
    row; texts move once, by key, and their n-grams are counted in place. Rows without ``pred`` are left out.
    """

    def counted(texts, n: int) -> Counter:
        return Counter(g for t in texts if t is not None for g in (t if n == 1 else zip(*(t[i:] for i in range(n)))))

    def measure(rows):
        rows = [(p, r or []) for p, r in rows if p is not None]
        out = []
        for n in orders if rows else ():
            said = counted((p for p, _ in rows), n)
            sides = [counted((r[i] for _, r in rows if i < len(r)), n) for i in range(max(len(r) for _, r in rows))]
            best = reduce(or_, sides, Counter())
            out.append((n, (said & best).total(), said.total(), sides[0].total() if sides else 0))
        return out

    return _per_key(df, keys, {"_pred": pred, "_refs": refs}, "n int, matched bigint, n_pred bigint, n_ref bigint", measure)


def rouge_n(df, by, key="pair_id", pred="prediction", ref="reference", orders=(1, 2)):
    """Mean n-gram F1 times 100 (the plain mean, not a bootstrap middle)."""
    rows = df.select(*by, key, F.col(pred).alias("_p"), F.col(ref).alias("_r"))
    counts = ngram_overlap(rows, [*by, key], words(F.col("_p")), F.array(words(F.col("_r"))), orders)
    f1 = F.when(F.col("matched") > 0, 2.0 * F.col("matched") / (F.col("n_pred") + F.col("n_ref"))).otherwise(0.0)
    return counts.groupBy(*by).agg(*[(F.avg(F.when(F.col("n") == n, f1)) * 100).alias(f"rouge{n}") for n in orders])


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; one big-integer step per element of ``b``."""
    if not len(a) or not len(b):
        return 0
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = places.get(y, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _shared_ratio(a: pd.Series, b: pd.Series, both_empty: float) -> pd.Series:
    return pd.Series(
        [2.0 * _lcs(x, y) / (len(x) + len(y)) if len(x) + len(y) else both_empty for x, y in zip(a, b)], dtype="float64"
    )


def _lcs_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return _shared_ratio(a, b, 0.0)


def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _shared_ratio(a, b, 1.0)


def lcs_f1(a, b) -> Column:
    """F1 of the longest common subsequence of two token arrays."""
    return F.pandas_udf(_lcs_f1, "double")(a, b)


def indel_ratio(a, b) -> Column:
    """1 - (insertions + deletions) / total length, on characters; 1 for two empty texts."""
    return F.pandas_udf(_indel_ratio, "double")(a, b)


def cjk_words(text: Column) -> Column:
    """Words; every CJK character is a word of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"), F.lit(0))


def rouge_l(df, by, key="pair_id", pred="prediction", refs="refs"):
    """Best LCS F1 over the references, mean times 100."""
    rows = df.select(*by, key, cjk_words(F.col(pred)).alias("_p"), F.explode_outer(refs).alias("_r"))
    scored = rows.withColumn("f", lcs_f1("_p", cjk_words(F.coalesce("_r", F.lit("")))))
    best = scored.groupBy(*by, key).agg(F.max("f").alias("f"))
    return best.groupBy(*by).agg((F.avg("f") * 100).alias("rougeL"))


# own tokenizer: words, and every other visible character by itself
BLEU_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def bleu_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BLEU_TOKEN), F.lit(0))


def corpus_bleu(df, by, key="pair_id", pred="prediction", refs="refs"):
    """Corpus BLEU-4 with exponential smoothing and brevity penalty (closest reference length)."""
    rows = df.select(*by, key, bleu_tokens(F.col(pred)).alias("_p"), F.transform(refs, bleu_tokens).alias("_r"))
    texts = df.select(*by, key, F.col(pred).alias("_p"), (F.col(refs) if isinstance(refs, str) else refs).alias("_r"))
    counts = ngram_overlap(texts, [*by, key], bleu_tokens(F.col("_p")), F.transform("_r", bleu_tokens))
    sums = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in (1, 2, 3, 4) for c in ("matched", "n_pred")]
    )
    size = F.size("_p")
    closest = F.array_min(
        F.transform("_r", lambda r: F.struct(F.abs(F.size(r) - size).alias("gap"), F.size(r).alias("len")))
    )["len"]
    lengths = rows.groupBy(*by).agg(F.sum(size).alias("sys_len"), F.sum(closest).alias("ref_len"))
    log_sum, zeros = F.lit(0.0), F.lit(0)
    for n in (1, 2, 3, 4):
        right, total = F.col(f"matched{n}"), F.col(f"n_pred{n}")
        zeros = zeros + F.when(right == 0, 1).otherwise(0)
        smooth = 100.0 / (F.pow(F.lit(2.0), zeros) * total)
        log_sum = log_sum + F.log(F.when(right == 0, smooth).otherwise(100.0 * right / total))
    penalty = F.when(F.col("sys_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("sys_len"))).otherwise(1.0)
    score = F.when(F.col("n_pred4") > 0, penalty * F.exp(log_sum / 4)).otherwise(0.0)
    return lengths.join(sums, list(by)).select(*by, score.alias("bleu"), "sys_len", "ref_len")


def corpus_gleu(df, by, key="pair_id", pred="prediction", ref="reference"):
    """Matched n-grams (1-4) over the larger of both totals, summed over the corpus."""
    rows = df.select(*by, key, F.col(pred).alias("_p"), F.col(ref).alias("_r"))
    counts = ngram_overlap(rows, [*by, key], words(F.col("_p")), F.array(words(F.col("_r"))))
    per = counts.groupBy(*by, key).agg(
        F.sum("matched").alias("m"), F.greatest(F.sum("n_pred"), F.sum("n_ref")).alias("t")
    )
    return per.groupBy(*by).agg((F.sum("m") / F.sum("t") * 100).alias("gleu"))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def probe_scores(df, by, pred="prediction", ref="reference"):
    """Shares of exact matches and of edit similarity above 0.75."""
    p, r = F.col(pred), F.col(ref)
    hundred = lambda flag: F.avg(F.when(flag, 100.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        hundred(p == r).alias("exact_match"), hundred(edit_similarity(p, r) > 0.75).alias("edit_similarity")
    )


def lcs_share(df, by, pred="prediction", ref="reference", floor=0.75):
    """Share of rows whose LCS F1 is above ``floor``."""
    rows = df.select(*by, words(F.col(pred)).alias("_p"), words(F.col(ref)).alias("_r")).withColumn("f", lcs_f1("_p", "_r"))
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("f") > floor, 100.0).otherwise(0.0)).alias("rougeL"))


def code_line(text: Column) -> Column:
    """First line without backtick, ``#`` or ``//``."""
    lines = F.split(F.regexp_replace(text, r"^\n+", ""), "\n")
    return F.coalesce(F.try_element_at(F.filter(lines, lambda l: ~F.regexp_like(l, F.lit("`|#|//"))), F.lit(1)), F.lit(""))


def code_similarity(df, by, key="pair_id", pred="prediction", refs="refs"):
    """Fuzzy ratio of the first code line, best over the references, mean times 100."""
    rows = df.select(*by, key, code_line(F.col(pred)).alias("_p"), F.explode(refs).alias("_r"))
    best = rows.withColumn("f", indel_ratio("_p", "_r")).groupBy(*by, key).agg(F.max("f").alias("f"))
    return best.groupBy(*by).agg((F.avg("f") * 100).alias("score"))


def truthfulness(sims: DataFrame, by, key="item_id"):
    """From (item, is_true, sim): best true similarity, its lead over the best false one, share of leads > 0."""
    per = sims.groupBy(*by, key).agg(
        F.max(F.when(F.col("is_true"), F.col("sim"))).alias("t"), F.max(F.when(~F.col("is_true"), F.col("sim"))).alias("f")
    )
    return per.groupBy(*by).agg(
        F.avg("t").alias("max"),
        F.avg(F.col("t") - F.col("f")).alias("diff"),
        F.avg((F.col("t") > F.col("f")).cast("double")).alias("acc"),
    )
