"""Token sequences: masking, truncation, prompt/answer rows, schedules and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.draws import bits, uniform

# fixed value: id of the mask token
MASK_ID = 126336


def _mask(df: DataFrame, keep: Column, eps: float, seed: int, mask_id: int) -> DataFrame:
    t = uniform(seed, "seq_id")
    rows = df.withColumn("p_mask", (1 - eps) * t + eps)
    flags = F.transform(
        "input_ids", lambda _, i: (uniform(seed + 1, F.col("seq_id"), i) < F.col("p_mask")) & (i >= keep)
    )
    rows = rows.withColumn("masked", flags)
    noisy = F.zip_with("input_ids", "masked", lambda x, m: F.when(m, F.lit(mask_id)).otherwise(x))
    return rows.withColumn("noisy", noisy)


def mask_tokens(seqs: DataFrame, eps: float = 1e-3, seed: int = 0, mask_id: int = MASK_ID) -> DataFrame:
    """Per sequence a ratio p = (1 - eps) t + eps with t uniform; every token masked with chance p."""
    return _mask(seqs, F.lit(0), eps, seed, mask_id)


def truncate_random(seqs: DataFrame, share: float = 0.01, seed: int = 0) -> DataFrame:
    """``share`` of the sequences cut to a uniform length in [1, L]."""
    length = F.size("input_ids")
    cut = (F.floor(uniform(seed + 1, "seq_id") * length) + 1).cast("int")
    chosen = (uniform(seed, "seq_id") < share) & (length > 0)
    return seqs.withColumn("input_ids", F.when(chosen, F.slice("input_ids", F.lit(1), cut)).otherwise(F.col("input_ids")))


def sft_rows(seqs: DataFrame, length: int, eos_id: int, eps: float = 1e-3, seed: int = 0, mask_id: int = MASK_ID) -> DataFrame:
    """Prompt + answer padded with end tokens to ``length``; only the answer is masked.

    ``weight`` is 1 / (p * answer length) on masked places, 0 elsewhere.
    """
    pad = F.array_repeat(F.lit(eos_id), F.greatest(F.lit(length) - F.size("prompt_ids") - F.size("answer_ids"), F.lit(0)))
    rows = seqs.withColumn("input_ids", F.concat("prompt_ids", "answer_ids", pad))
    rows = rows.withColumn("prompt_length", F.size("prompt_ids"))
    rows = rows.withColumn("answer_length", F.size("input_ids") - F.col("prompt_length"))
    rows = _mask(rows, F.col("prompt_length"), eps, seed, mask_id)
    weight = F.transform("masked", lambda m: F.when(m, 1 / (F.col("p_mask") * F.col("answer_length"))).otherwise(0.0))
    return rows.withColumn("weight", weight).drop("prompt_ids", "answer_ids")


def stratified_masks(pairs: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """``batch`` masks per (item, prompt_length, target_length) with evenly spread mask counts.

    Row b masks x = ((round(k + b T / batch) - 1) mod T) + 1 target places,
    those with the smallest hashes; k is uniform in [1, T].
    """
    target = F.col("target_length")
    first = (F.floor(uniform(seed, "item_id") * target) + 1).cast("int")
    rows = pairs.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    spread = F.bround(first + F.col("batch") * (target / F.lit(float(batch)))).cast("int")
    rows = rows.withColumn("masked", F.pmod(spread - 1, target) + 1)
    places = F.transform(
        F.sequence(F.lit(0), target - 1),
        lambda i: F.struct(bits(seed + 1, "item_id", "batch", i).alias("h"), i.alias("i")),
    )
    chosen = F.slice(F.array_sort(places), F.lit(1), F.col("masked"))
    rows = rows.withColumn("positions", F.array_sort(F.transform(chosen, lambda s: s["i"] + F.col("prompt_length"))))
    return rows.withColumn("ratio", F.col("masked") / target)


def unmask_schedule(seqs: DataFrame, steps: int, masked: str = "masked") -> DataFrame:
    """How many masked tokens each step reveals: the quotient, and one more for the first remainder steps."""
    n = F.col(masked)
    rows = seqs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    more = F.when(F.col("step") < n % steps, 1).otherwise(0)
    return rows.withColumn("reveal", (F.floor(n / steps) + more).cast("bigint"))


def continuation_probes(docs: DataFrame, n: int, m: int, tokens: str = "tokens") -> DataFrame:
    """``m`` evenly spaced cuts per document: the prompt before, and the next ``n`` tokens as reference."""
    size = F.size(tokens)
    last = F.when(size >= n + max(m, 2), size - n).otherwise(F.greatest(size, F.lit(2)))
    rows = docs.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    cut = (2 + F.floor(F.col("probe") * (last - 2) / max(m - 1, 1))).cast("int")
    rows = rows.withColumn("cut", cut)
    return rows.withColumn("prompt", F.array_join(F.slice(tokens, F.lit(1), F.col("cut")), " ")).withColumn(
        "reference", F.array_join(F.slice(tokens, F.col("cut") + 1, F.lit(n)), " ")
    ).drop(tokens)
