"""Exactness and question-answering metrics.

Every metric is a per-row score column, then one ``groupBy(by)``: Spark
aggregates partially before the shuffle, so slices of any size are fine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.functions.text import first_match, let, strip
from evalmill.operators.overlap import bag_counts, bag_overlap, f1_of


def share(flag: Column) -> Column:
    """Percentage of true; null counts as false."""
    return F.avg(F.when(flag, 100.0).otherwise(0.0))


def mean_score(df: DataFrame, by: Sequence[str], score: Column, name: str) -> DataFrame:
    return df.groupBy(*by).agg(score.alias(name))


def accuracy(df, by, pred="answer", ref="gold"):
    same = F.col(pred).cast("string").eqNullSafe(F.col(ref).cast("string"))
    return mean_score(df, by, share(same), "accuracy")


def exact_match(df, by, pred="prediction", refs="refs"):
    """Cleaned prediction among cleaned or raw references."""
    accepted = F.array_union(F.transform(refs, E.general), F.col(refs))
    return mean_score(df, by, share(F.array_contains(accepted, E.general(F.col(pred)))), "exact_match")


def short_answer(text: Column) -> Column:
    """First line, lower case, after the last ``answer is``, cleaned."""
    line = F.lower(F.substring_index(strip(text), "\n", 1))
    return E.general(F.substring_index(line, "answer is", -1))


def contained_answer(df, by, pred="prediction", refs="refs"):
    found = F.exists(refs, lambda r: F.contains(short_answer(F.col(pred)), F.lower(E.general(r))))
    return mean_score(df, by, share(found), "score")


def equal_answer(df, by, pred="prediction", refs="refs"):
    found = F.exists(refs, lambda r: short_answer(F.col(pred)) == F.lower(E.general(r)))
    return mean_score(df, by, share(found), "score")


def fuzzy_match(df, by, pred="prediction", ref="reference"):
    """Either text contains the other; references are split at ``|``."""
    stated = F.coalesce(first_match(F.col(pred), r"(?i)Answer\s*:\s*([^\n]+)"), F.col(pred))
    cleaned = E.qa_normalise(stated)

    def hit(r: Column) -> Column:
        other = E.qa_normalise(r)
        either = F.contains(cleaned, other) | F.contains(other, cleaned)
        return F.when((cleaned == "") | (other == ""), cleaned == other).otherwise(either)

    return mean_score(df, by, share(F.exists(F.split(ref, r"\|"), hit)), "accuracy")


def either_form_contained(df, by, pred="prediction", ref="reference"):
    cleaned = E.general(F.col(pred))
    found = F.contains(cleaned, E.general(F.col(ref))) | F.contains(cleaned, F.col(ref))
    return mean_score(df, by, share(found), "score")


def first_word_accuracy(df, by, pred="prediction", ref="reference"):
    word = F.substring_index(strip(pred), " ", 1)
    word = F.regexp_extract(word, r"^[^!-/:-@\[-`{-~]*", 0)
    return mean_score(df, by, share(E.general(word) == E.general(F.col(ref))), "accuracy")


def token_f1(df, by, key="pair_id", pred="prediction", refs="refs"):
    """Best bag-of-words F1 over the references, and exact match, per slice."""
    rows = df.select(*by, key, F.col(pred).alias("_p"), F.posexplode(refs).alias("_ref", "_r"))
    rows = rows.withColumn("_p", E.qa_normalise(F.col("_p"))).withColumn("_r", E.qa_normalise(F.col("_r")))
    rows = rows.withColumn("_em", (F.col("_p") == F.col("_r")).cast("int"))
    counts = bag_overlap(rows, [*by, key, "_ref", "_em"], _tokens(F.col("_p")), _tokens(F.col("_r")))
    best = counts.groupBy(*by, key).agg(F.max(f1_of()).alias("f1"), F.max("_em").alias("em"))
    return best.groupBy(*by).agg((F.avg("f1") * 100).alias("f1"), (F.avg("em") * 100).alias("em"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


# fixed values: words that do not count as keywords
STOP_WORDS_EN = (
    "and to of in her was with for it from is that his he by she they or at because be on are their what as had "
    "were about being this who but have has when which does"
).split()


def gated_f1(df, by, key="pair_id", pred="prediction", ref="reference", keyword="keyword", floor=0.2):
    """Token F1 on the first reference, 0 unless enough of the keyword's words are in the prediction."""
    bag = lambda c: _tokens(E.qa_normalise(F.col(c)))
    counts = bag_counts(df, [*by, key], {"p": bag(pred), "r": bag(ref), "k": bag(keyword)})
    content = F.when(~F.col("t").isin(STOP_WORDS_EN), F.least("p", "k")).otherwise(0)
    rows = counts.groupBy(*by, key).agg(
        F.sum(F.least("p", "r")).alias("both"), F.sum("p").alias("n_a"), F.sum("r").alias("n_b"),
        (F.sum(content) / F.nullif(F.sum("k"), F.lit(0))).alias("recall"),
    )
    passed = F.col("recall").isNull() | (F.col("recall") >= floor)
    return rows.groupBy(*by).agg((F.avg(F.when(passed, f1_of()).otherwise(0.0)) * 100).alias("f1"))


def numeric_accuracy(df, by, pred="prediction", ref="reference", tolerance=1e-3):
    """Close numbers (below ``tolerance``) or equal text; what is not a number is wrong."""
    gap = F.abs(F.col(pred).try_cast("double") - F.col(ref).try_cast("double"))
    return mean_score(df, by, share((F.col(pred) == F.col(ref)) | (gap < tolerance)), "accuracy")


def within_limits(df, by, pred="prediction", lower="lower", upper="upper"):
    value = F.col(pred).try_cast("double")
    return mean_score(df, by, share(value.between(F.col(lower), F.col(upper))), "accuracy")


# fixed values: TeX clean-up of a math string before comparing; plain replacements, then patterns, in this order
MATH_PLAIN = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0."),
]
MATH_PATTERNS = [
    (r"\\text\{ .*$", ""), (r"^\.", "0."), (r"^[^=]{0,2}=([^=]*)$", "$1"), (r"\\sqrt([^{])", r"\\sqrt{$1}"), (" ", ""),
    (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), (r"\\frac([^{])\{", r"\\frac{$1}{"), (r"^0\.5$", r"\\frac{1}{2}"),
    (r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}"),
]


def math_string(text: Column) -> Column:
    for old, new in MATH_PLAIN:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in MATH_PATTERNS:
        text = F.replace(text, F.lit(pattern), F.lit(new)) if pattern == " " else F.regexp_replace(text, pattern, new)
    return text


# fixed values: the second clean-up, in order; an entry is a plain text or a compiled pattern, and what takes its place
MATH_BEFORE_UNIT = [
    ("\n", ""), (re.compile(r"\.+$"), ""), ("\\!", ""), ("\\ ", ""), ("\\\\", "\\"), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
]
MATH_UNIT = r"\\text\{.*?\}$"
MATH_AFTER_UNIT = [
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\text", ""), ("x\\in", ""), ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0."), ("\\cdot", ""),
    ("infinity", "\\infty"),
]
MATH_AFTER_INFINITY = [("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", ""), (re.compile(r"\\mbox\{.*?\}"), "")]
MATH_NUMBERS = [
    (re.compile(r"(\d+)\.0+([^\d])"), "$1$2"), (re.compile(r"(\d+)\.0+$"), "$1"), (re.compile(r"^\."), "0."), (re.compile(r"^[^=]{0,2}=([^=]*)$"), "$1"),
    (re.compile(r"\\sqrt(\w+)"), r"\\sqrt{$1}"), (" ", ""), (re.compile(r"\\frac([^{])([^{])"), r"\\frac{$1}{$2}"), (re.compile(r"\\frac([^{])\{"), r"\\frac{$1}{"),
    (re.compile(r"^(-?\d+)/(-?\d+)$"), r"\\frac{$1}{$2}"),
]


def rewritten(text: Column, steps) -> Column:
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new)) if isinstance(old, str) else F.regexp_replace(text, f"(?U){old.pattern}", new)
    return text


def math_string_v2(text: Column) -> Column:
    """The wider clean-up: units, intervals, infinities, the imaginary unit and trailing zeros are made alike too.

    Values that several steps look at are bound once, as the steps would otherwise multiply.
    """
    without_unit = lambda s: let(strip(F.regexp_replace(s, MATH_UNIT, "")), lambda bare: F.when(bare != "", bare).otherwise(s))
    infinite = lambda s: F.when(F.contains(s, F.lit("\\infty")), s).otherwise(F.replace(s, F.lit("inf"), F.lit("\\infty")))
    imaginary = lambda s: F.when(F.contains(s, F.lit("j")) & ~F.contains(s, F.lit("i")), F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)
    text = let(rewritten(strip(text), MATH_BEFORE_UNIT), without_unit)
    text = let(rewritten(text, MATH_AFTER_UNIT), infinite)
    text = let(rewritten(text, MATH_AFTER_INFINITY), imaginary)
    return rewritten(text, MATH_NUMBERS)


def math_accuracy(df, by, pred="prediction", ref="reference", version="v1"):
    """Share of rows whose strings are equal after the first (``v1``) or the wider (``v2``) clean-up."""
    clean = {"v1": math_string, "v2": math_string_v2}[version]
    same = clean(F.col(pred)).eqNullSafe(clean(F.col(ref)))
    return mean_score(df, by, share(same), "accuracy")


def nearest_candidate(df, by, key="item_id", pred="prediction", candidates="candidates", label="label"):
    """Index of the candidate (array of aliases) with the smallest edit distance; the first on ties."""
    per = F.transform(
        candidates,
        lambda aliases, i: F.struct(
            F.array_min(F.transform(aliases, lambda a: F.levenshtein(F.col(pred), a))).alias("d"), i.alias("i")
        ),
    )
    return mean_score(df, by, share(F.array_min(per)["i"] == F.col(label)), "accuracy")


def match_option(pred: Column, options: dict[str, Column]) -> Column:
    """Letter; else wording; else the only option text contained; else the nearest text."""
    pred = strip(pred)
    letters = "".join(options)
    exact = F.when(pred.isin(list(options)), pred)
    worded = F.nullif(E.first_option(letters, cushion=False)(pred), F.lit(""))
    held = F.filter(
        F.array(*[F.when(F.contains(F.lower(pred), F.lower(text)), F.lit(k)) for k, text in options.items()]),
        lambda k: k.isNotNull(),
    )
    only = F.when(F.size(held) == 1, F.try_element_at(held, F.lit(1)))
    nearest = F.array_min(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.least(
                            F.levenshtein(pred, F.lit(k)),
                            F.levenshtein(pred, text),
                            F.levenshtein(pred, F.concat(F.lit(f"{k}. "), text)),
                        ).alias("d"),
                        F.lit(k).alias("k"),
                    )
                    for k, text in options.items()
                ]
            ),
            lambda s: s["d"].isNotNull(),
        )
    )["k"]
    return F.coalesce(exact, worded, only, nearest, F.lit(""))


def option_similarity(df, by, options: dict[str, str], pred="prediction", ref="gold"):
    parsed = match_option(F.col(pred), {k: F.col(c) for k, c in options.items()})
    return mean_score(df, by, share(parsed == F.col(ref)), "accuracy")


def option_abstention(df, by, options="ABCD", pred="prediction", ref="gold"):
    held = F.filter(F.array(*[F.lit(o) for o in options]), lambda o: F.contains(F.col(pred), o))
    return df.groupBy(*by).agg(
        share((F.size(held) == 1) & (F.get(held, F.lit(0)) == F.col(ref))).alias("score"),
        share(F.size(held) == 0).alias("abstention"),
    )


def valid_accuracy(df, by, pred="answer", ref="gold", invalid="invalid"):
    """Accuracy, accuracy over valid answers, share of valid answers; 4 decimals, then percent."""
    n = F.count(F.lit(1))
    valid = F.count_if(F.col(pred) != invalid)
    right = F.count_if(F.col(pred) == F.col(ref))
    right_valid = F.count_if((F.col(pred) == F.col(ref)) & (F.col(pred) != invalid))
    return df.groupBy(*by).agg(
        (F.round(right / n, 4) * 100).alias("accuracy"),
        (F.round(right_valid / F.nullif(valid, F.lit(0)), 4) * 100).alias("valid_accuracy"),
        (F.round(valid / n, 4) * 100).alias("valid_frac"),
    )


# fixed values: words of an apology or refusal
FAIL_WORDS = ["sorry", "apologize", "apology", "unfortunately", "couldn't"]


def pass_rate(df, by, pred="prediction", fail_words: Sequence[str] = tuple(FAIL_WORDS)):
    refused = F.regexp_like(F.lower(F.col(pred)), F.lit("|".join(fail_words)))
    return mean_score(df, by, share((F.length(pred) > 0) & ~refused), "pass_rate")


def extraction_rate(df, by, answer="answer"):
    return mean_score(df, by, share(F.length(answer) > 0), "extract_rate")


def prefix_match(df, by, pred="prediction", ref="reference"):
    """Leading numbers that agree, averaged, times 100."""

    def numbers(text: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(r"[0-9]+"), F.lit(0))
        return F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))

    same = F.zip_with(numbers(pred), numbers(ref), lambda a, b: a.eqNullSafe(b))
    wrong = F.array_position(same, False)
    # zip_with pads the shorter side with null, so the first false is never past it
    lead = F.when(wrong == 0, F.size(same)).otherwise(wrong - 1)
    return mean_score(df, by, F.avg(lead.cast("double")) * 100, "score")


def number_ratio(df, by, pred="prediction", target="target"):
    found = F.regexp_extract_all(F.col(pred), F.lit(r"[0-9]+"), F.lit(0))
    right = F.size(F.filter(found, lambda x: x == F.col(target)))
    score = F.when(F.size(found) == 0, 0.0).otherwise(right / F.size(found))
    return mean_score(df, by, F.avg(score) * 100, "score")


def class_credit(df, by, classes: Sequence[str], pred="prediction", ref="gold"):
    """1/n when the gold class is among the n classes found; proper substrings of the gold do not count."""
    listed = F.array(*[F.lit(c) for c in classes])
    found = F.filter(
        listed,
        lambda c: F.contains(F.col(pred), c) & ~(F.contains(F.col(ref), c) & (c != F.col(ref))),
    )
    score = F.when(F.array_contains(found, F.col(ref)), 1.0 / F.size(found)).otherwise(0.0)
    return mean_score(df, by, F.avg(score) * 100, "score")


def reversal_accuracy(df, by, pred="prediction", ref="answer"):
    """Gold line inside the output; ``by`` holds the direction."""
    return mean_score(df, by, share(F.contains(F.col(pred), F.col(ref))), "accuracy")


def coverage(df, by, pred="prediction", refs="refs"):
    """Share of references covered, any covered, all covered (case-insensitive)."""
    lowered = F.lower(F.col(pred))
    hit = F.filter(refs, lambda r: F.contains(lowered, F.lower(r)))
    return df.groupBy(*by).agg(
        (F.avg(F.size(hit) / F.size(refs)) * 100).alias("part_match"),
        share(F.size(hit) > 0).alias("any_match"),
        share(F.size(hit) == F.size(refs)).alias("all_match"),
    )


def point_weighted(df, by, pred="letters", refs="ref_letters"):
    """2 points for an equal choice set, 1 for a part of it, over 2 per sub-question.

    A prediction of the wrong length counts as all wrong.
    """
    n = F.size(refs)

    def letters(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    points = F.zip_with(
        pred,
        refs,
        lambda p, r: F.when(p == r, 2).when(F.size(F.array_except(letters(p), letters(r))) == 0, 1).otherwise(0),
    )
    earned = F.when(F.size(pred) == n, F.aggregate(points, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return mean_score(df, by, F.sum(earned) / (2 * F.sum(n)) * 100, "score")
