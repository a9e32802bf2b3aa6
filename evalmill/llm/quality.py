"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import SPACE, words_of

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on are as by this was from at or an "
    "le la les de des du et en un une que est dans pour par sur au avec qui "
    "der die das und ist den von zu ein eine mit im nicht sch auf dem für sich "
    "el los las y por con para una del se lo su no es como"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``least <= feature <= most``; a missing bound is open. A feature without a value (no words) breaks no rule."""

    feature: str
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        value = F.col(self.feature)
        low = value < self.least if self.least is not None else F.lit(False)
        high = value > self.most if self.most is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))


#: Lengths, symbols, stop words and lines; bounds are wide enough for short and for very long honest prose.
RULES = (
    Rule("n_words", least=1),
    Rule("word_length", least=2.5, most=12.0),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_ratio", least=0.02),
    Rule("stop_kinds", least=1),
    Rule("dup_line_ratio", most=0.5),
)


def written(words: Sequence[str]) -> list[str]:
    """The words as they stand in a text: small or with a capital, bare or before a comma or full stop."""
    return [form + end for w in words for form in sorted({w, w.capitalize(), w.upper()}) for end in ("", ",", ".")]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios the rules speak of, as columns of the same projection.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text is an empty one. Ratios are null where there is nothing to divide by.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words_of(F.col(text)))
    df = df.withColumns(
        {
            "_grams": F.when(
                F.size("_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
            "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
            "_known": F.filter("_words", lambda w: w.isin(written(STOP_WORDS))),
        }
    )
    n = F.size("_words")
    df = df.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": repeated(F.col("_grams")).cast("bigint"),
        }
    )
    return df.withColumns(
        {
            "word_length": F.try_divide("word_chars", "n_words"),
            "symbol_ratio": F.try_divide("n_symbols", "n_words"),
            "stop_ratio": F.try_divide(F.size("_known"), "n_words"),
            "stop_kinds": F.size(F.array_distinct("_known")),
            "dup_line_ratio": F.try_divide("n_dup_lines", F.size("_lines")),
        }
    ).drop("_words", "_grams", "_lines", "_known")


def repeated(grams: Column) -> Column:
    """Words covered by windows of three whose hash stands in ``grams`` twice or more; window i covers words i to i+2.

    Sorted hashes bring equal ones together. A few repeated hashes are then looked up at every place; for many,
    the places are sorted along with the hashes, which stays near linear for any text. Both give the same places.
    """

    def twice(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda g, j: g == F.get(s, j - 1)))

    def found(again: Column) -> Column:
        return F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(again, g), i)), lambda i: i.isNotNull())

    def placed(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def with_sorted(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def cover(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + 2 - F.greatest(acc["end"], i - 1)).alias("n"), (i + 2).alias("end")),
            lambda acc: acc["n"],
        )

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    few = with_sorted(
        with_sorted(F.sort_array(grams), twice),
        lambda again: F.when(F.size(again) <= 64, cover(found(again))).otherwise(with_sorted(pairs, lambda s: cover(placed(s)))),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(few)


def quality_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, keep_features: bool = True
) -> DataFrame:
    """Every row with its counts, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated
    windows of three. ``kept``: not base_failed and no rule of the table broken. Null, empty and blank texts
    have zero counts and fail. Repeated rows are judged alike. Columns of ``docs`` that carry a name used here
    are replaced by the computed ones.
    """
    names = [r.feature for r in rules]
    taken = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *names}
    base = docs.drop(*[c for c in docs.columns if c in taken and c != text])
    df = features(base, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule.broken()
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~broken)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [c for c in df.columns if c not in base.columns and c not in {*counts, "base_failed", "kept"}] if keep_features else []
    # behind a generator, so that a filter on the verdict is not pushed down as a second copy of all the expressions
    judged = F.explode(F.array(F.struct(*counts, *extra, "base_failed", "kept"))).alias("_judged")
    return df.select(*[F.col(f"`{c}`") for c in base.columns], judged).select(*[F.col(f"`{c}`") for c in base.columns], "_judged.*")


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows the rules keep, with the columns they came with."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_body"))
    return quality_rules(marked, rules, text="_body", keep_features=False).filter("kept").select("_row.*")
