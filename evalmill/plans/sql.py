"""Small pieces shared by the registered queries: rounding, and SQL text of the cleaning rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places, so that engines can be compared."""
    return df.select(
        *[(F.round(f"`{c}`", 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def DROP_ARTICLES(x: str) -> str:
    squeezed = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({squeezed}, ' '), lambda w: lower(w) NOT IN ('a', 'an', 'the')), ' ')"


def GENERAL(x: str) -> str:
    head = rf"regexp_extract({x}, '^[^\n.,]*')"
    return DROP_ARTICLES(rf"regexp_replace({head}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')")


def QA_NORM(x: str) -> str:
    return DROP_ARTICLES(rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')")


def SHORT(x: str) -> str:
    line = rf"lower(split_part(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1))"
    return GENERAL(f"string_split({line}, 'answer is')[-1]")


def LCS(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: a row of bits in 100-bit words, folded over ``b``.

    A step adds the row's places that match the element to the row, with carries from word to word; the cleared
    bits count the subsequence.
    """
    full = f"CASE WHEN w < len({a}) // 100 THEN {2**100 - 1}::HUGEINT ELSE (1::HUGEINT << (len({a}) % 100)::INT) - 1 END"
    words = f"range((len({a}) + 99) // 100)"
    bit = f"CASE WHEN {a}[i + 1] = y THEN 1::HUGEINT << (i - 100 * w)::INT ELSE 0::HUGEINT END"
    hit = f"(row_[w + 1] & coalesce(list_sum(list_transform(range(100 * w, least(len({a}), 100 * w + 100)), lambda i: {bit})), 0)::HUGEINT)"
    total = f"(row_[w + 1] + {hit} + st[1])"
    new = f"((({total} % {2**100}::HUGEINT) | (row_[w + 1] - {hit})) & ({full}))"
    step = f"list_reduce({words}, lambda st, w: list_prepend({total} // {2**100}::HUGEINT, list_append(st[2:], {new})), [0::HUGEINT])[2:]"
    start = f"list_transform({words}, lambda w: {full})"
    return f"(len({a}) - coalesce(list_sum(list_transform(list_reduce({b}, lambda row_, y: {step}, {start}), lambda x: bit_count(x))), 0))"
