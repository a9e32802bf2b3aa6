"""Instruction following: verifiers as column predicates, strict and loose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.text import let, strip

# a verifier takes the response and its arguments (map<string,string>)
Verifier = Callable[[Column, Column], Column]


def _relation(count: Column, kw: Column) -> Column:
    """``at least`` (default) or ``less than`` the number ``num``."""
    num = kw["num"].cast("int")
    return F.when(kw["relation"] == "less than", count < num).otherwise(count >= num)


def _listed(kw: Column, name: str) -> Column:
    return F.split(kw[name], r"\|")


def _occurrences(text: Column, word: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def _word_in(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])")))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda p: strip(p) != "")


def first_word(paragraph: Column) -> Column:
    """The first word in lower case, without quotes before it and up to its first punctuation mark."""
    word = F.regexp_replace(F.get(F.split(strip(paragraph), r"\s+"), F.lit(0)), "^'*\"*", "")
    return F.lower(F.regexp_extract(word, "^[^.,?!'\"]*", 0))


VERIFIERS: dict[str, Verifier] = {
    "keywords:existence": lambda x, kw: F.forall(
        _listed(kw, "keywords"), lambda w: F.contains(F.lower(x), F.lower(w))
    ),
    "keywords:frequency": lambda x, kw: _relation(_occurrences(F.lower(x), F.lower(kw["keyword"])), kw),
    "keywords:forbidden_words": lambda x, kw: ~F.exists(_listed(kw, "keywords"), lambda w: _word_in(x, w)),
    "keywords:letter_frequency": lambda x, kw: _relation(_occurrences(F.lower(x), F.lower(kw["letter"])), kw),
    "length_constraints:number_sentences": lambda x, kw: _relation(
        F.size(F.regexp_extract_all(x, F.lit(r"[^.!?\s][^.!?]*"), F.lit(0))), kw
    ),
    "length_constraints:number_paragraphs": lambda x, kw: F.size(_parts(x, r"\s?\*\*\*\s?")) == kw["num"].cast("int"),
    "length_constraints:number_words": lambda x, kw: _relation(
        F.size(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), kw
    ),
    "length_constraints:nth_paragraph_first_word": lambda x, kw: let(
        _parts(x, "\n\n"),
        lambda p: (F.size(p) == kw["num"].cast("int"))
        & (first_word(F.get(p, kw["nth"].cast("int") - 1)) == F.lower(kw["first_word"])),
    ),
    "detectable_content:number_placeholders": lambda x, kw: F.regexp_count(x, F.lit(r"(?s)\[.*?\]")) >= kw["num"].cast("int"),
    "detectable_content:postscript": lambda x, kw: F.contains(F.lower(x), F.lower(kw["marker"])),
    "detectable_format:number_bullet_lists": lambda x, kw: F.regexp_count(x, F.lit(r"(?m)^\s*\*[^*\n].*$|^\s*-.*$"))
    == kw["num"].cast("int"),
    "detectable_format:constrained_response": lambda x, kw: F.exists(
        _listed(kw, "options"), lambda o: F.contains(strip(x), o)
    ),
    "detectable_format:number_highlighted_sections": lambda x, kw: F.regexp_count(
        x, F.lit(r"\*\*[^\n*]*[^\n*\s][^\n*]*\*\*|\*[^\n*]*[^\n*\s][^\n*]*\*")
    )
    >= kw["num"].cast("int"),
    "detectable_format:multiple_sections": lambda x, kw: F.size(
        F.regexp_extract_all(x, F.concat(F.lit(r"\Q"), kw["marker"], F.lit(r"\E\s?\d+")), F.lit(0))
    )
    >= kw["num"].cast("int"),
    "detectable_format:json_format": lambda x, kw: F.get_json_object(
        F.regexp_replace(strip(x), r"^```(?:json|Json|JSON)?|```$", ""), "$"
    ).isNotNull(),
    "detectable_format:title": lambda x, kw: F.regexp_like(x, F.lit(r"<<[^\n]*[^\s<>][^\n]*>>")),
    "combination:two_responses": lambda x, kw: let(
        _parts(x, r"\*{6}"), lambda p: (F.size(p) == 2) & (strip(F.get(p, F.lit(0))) != strip(F.get(p, F.lit(1))))
    ),
    "combination:repeat_prompt": lambda x, kw: F.lower(strip(x)).startswith(F.lower(strip(kw["prompt"]))),
    "startend:end_checker": lambda x, kw: F.lower(strip(F.regexp_replace(strip(x), '^"+|"+$', ""))).endswith(
        F.lower(strip(kw["phrase"]))
    ),
    "change_case:english_capital": lambda x, kw: (x == F.upper(x)) & (x != F.lower(x)),
    "change_case:english_lowercase": lambda x, kw: (x == F.lower(x)) & (x != F.upper(x)),
    "change_case:capital_word_frequency": lambda x, kw: _relation(
        F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}])\p{Lu}[\p{Lu}\p{N}]*(?![\p{L}\p{N}])")), kw
    ),
    "punctuation:no_comma": lambda x, kw: ~F.contains(x, F.lit(",")),
    "startend:quotation": lambda x, kw: (F.length(strip(x)) > 1) & strip(x).startswith('"') & strip(x).endswith('"'),
}


def variants(text: Column) -> Column:
    """The response as it is, without first, last or both lines, and each of these without stars."""

    def build(lines: Column) -> Column:
        n = F.size(lines)
        cut = lambda start, length: strip(F.array_join(F.slice(lines, start, F.greatest(length, F.lit(0))), "\n"))
        bases = [text, cut(2, n - 1), cut(1, n - 1), cut(2, n - 2)]
        return F.array(*bases, *[F.replace(b, F.lit("*"), F.lit("")) for b in bases])

    return let(F.split(text, "\n"), build)


def followed(text: Column, instruction: Column, names: list[str] | None = None) -> Column:
    """Whether one (id, kwargs) instruction is followed; an empty response never is."""
    check = F.lit(False)
    for name in names or list(VERIFIERS):
        check = F.when(instruction["id"] == name, VERIFIERS[name](text, instruction["kwargs"])).otherwise(check)
    return (strip(text) != "") & F.coalesce(check, F.lit(False))


def instruction_following(df: DataFrame, by, response="response", instructions="instructions", names: list[str] | None = None) -> DataFrame:
    """Prompt- and instruction-level shares, strict and loose, times 100.

    ``instructions`` is array<struct<id, kwargs map<string,string>>>. All is
    worked out inside the row; only the sums per slice are shuffled.
    """
    text = F.col(response)
    strict = F.transform(instructions, lambda i: followed(text, i, names))
    rows = df.withColumn("_strict", strict).withColumn("_variants", variants(text))
    loose = F.transform(instructions, lambda i: F.exists("_variants", lambda v: followed(v, i, names)))
    rows = rows.withColumn("_loose", loose)
    n = F.sum(F.size(instructions))
    hits = lambda c: F.sum(F.size(F.filter(c, lambda ok: ok)))
    everything = lambda c: F.avg(F.when(F.forall(c, lambda ok: ok), 100.0).otherwise(0.0))
    return rows.groupBy(*by).agg(
        everything("_strict").alias("prompt_strict"), (hits("_strict") / n * 100).alias("inst_strict"),
        everything("_loose").alias("prompt_loose"), (hits("_loose") / n * 100).alias("inst_loose"),
    )
