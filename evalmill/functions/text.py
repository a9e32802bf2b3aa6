"""Text column helpers shared by extraction and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English articles and ASCII punctuation
ARTICLES = ["a", "an", "the"]
PUNCTUATION = r"[!-/:-@\[-`{-~]"

WORD = r"[\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for rules that mention it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text) -> Column:
    """Text without white space (also line breaks) at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def drop_articles(text: Column) -> Column:
    """Drop article words from space-separated text."""
    words = F.filter(F.split(squeeze(text), " "), lambda w: ~F.lower(w).isin(ARTICLES))
    return F.array_join(words, " ")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by a space; empty when the text is shorter than n."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def last_of(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))
