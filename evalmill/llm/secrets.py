"""Secret scans with built-in functions only: three patterns, and windows of high entropy in long strings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,kind:string>>"

#: (kind, pattern, group whose length counts, least length). For access and hex the least length stands in the
#: pattern: a run that is too short cannot hold a longer match, so the same spans come out and fewer are made.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """Strings of one alphabet: a window of ``window`` characters is secret-like from ``bits`` of entropy on."""

    kind: str
    pattern: str
    window: int
    bits: float


#: The hexadecimal class first: a string belongs to the first class that it matches whole.
CLASSES = (CharClass("entropy_hex", "[0-9A-Fa-f]+", 24, 3.05), CharClass("entropy", "[A-Za-z0-9+/_=-]+", 20, 3.63))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: no digit or no letter, words or short numbers joined by signs, filler.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^([A-Za-z]*|[0-9]{1,4})([+/_=-]+([A-Za-z]*|[0-9]{1,4}))*$",
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh",
)
#: Characters of CANDIDATE lie between these two codes.
FIRST_CODE, CODES = ord("+"), ord("z") - ord("+") + 1


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def find_spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters; code points, end exclusive.

    The pieces between the matches give the places: both come from the same scan order.
    """
    none = F.array().cast(SPANS)
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("held"),
    )

    def walk(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.char_length(F.get(p["gaps"], i))
            end = start + F.char_length(F.get(p["hits"], i))
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
            good = F.char_length(F.get(p["held"], i)) >= least
            return F.struct(end.alias("pos"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        start = F.struct(F.lit(0).alias("pos"), none.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["hits"]) - 1), start, step, lambda acc: acc["spans"])

    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(none)


def hot_window(value: Column, window: int, bits: float) -> Column:
    """struct(first, last): places of the first and last window with at least ``bits`` of Shannon entropy, else (-1, -1).

    Every step takes one character in and one out: the counts and the sum of c*log2(c) are carried on, as
    entropy = log2(window) - sum / window.
    """
    weight = F.array(*[F.lit(0.0)] + [F.lit(c * math.log2(c)) for c in range(1, window + 2)])
    most = window * (math.log2(window) - bits)
    code = lambda at: F.ascii(F.substring(value, at, F.lit(1))) - FIRST_CODE

    def step(acc: Column, i: Column) -> Column:
        into, out = code(i), F.when(i > window, code(F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        moved = F.struct(into.alias("a"), out.alias("b"))

        def move(m: Column) -> Column:
            same = m["a"] == m["b"]
            up, down = F.get(acc["counts"], m["a"]), F.get(acc["counts"], m["b"])
            gain = F.get(weight, up + 1) - F.get(weight, up)
            loss = F.when(m["b"] >= 0, F.get(weight, down) - F.get(weight, down - 1)).otherwise(0.0)
            total = F.when(same, acc["total"]).otherwise(acc["total"] + gain - loss)
            counts = F.when(same, acc["counts"]).otherwise(
                F.transform(acc["counts"], lambda c, j: c + (j == m["a"]).cast("int") - (j == m["b"]).cast("int"))
            )
            return F.struct(counts.alias("counts"), total.alias("total"))

        def mark(n: Column) -> Column:
            hot = (i >= window) & (n["total"] <= most)
            return F.struct(
                n["counts"].alias("counts"),
                n["total"].alias("total"),
                F.when(hot & (acc["first"] < 0), i - window).otherwise(acc["first"]).alias("first"),
                F.when(hot, i - window).otherwise(acc["last"]).alias("last"),
            )

        return let(let(moved, move), mark)

    start = F.struct(
        F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    steps = F.sequence(F.lit(1), F.char_length(value))
    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> Column:
    """One span per candidate string with secret-like windows, from the first to the last of them.

    ``text`` is a plain column: the spans cut the candidates out of it.
    """

    def judge(span: Column) -> Column:
        value = F.substring(text, span["start"] + 1, span["end"] - span["start"])

        def named(c: CharClass):
            return lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"), F.lit(c.window).alias("window"), F.lit(c.kind).alias("kind"))

        def by_class(v: Column) -> Column:
            out = F.lit(None).cast("struct<first:int,last:int,window:int,kind:string>")
            for c in reversed(classes):
                out = F.when(v.rlike(f"^{c.pattern}$"), let(hot_window(v, c.window, c.bits), named(c))).otherwise(out)
            quiet = F.lit(False)
            for pattern in allowed:
                quiet = quiet | v.rlike(pattern)
            return F.when(~quiet, out)

        def place(h: Column) -> Column:
            found = F.struct(
                (span["start"] + h["first"]).alias("start"), (span["start"] + h["last"] + h["window"]).alias("end"), h["kind"].alias("kind")
            )
            return F.when(h["first"] >= 0, found)

        return let(let(value, by_class), place)

    return F.filter(F.transform(find_spans(text, CANDIDATE, ""), judge), lambda s: s.isNotNull())


def scan_secrets(docs: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """Add ``spans``: array of (start, end, kind) by start, then kind as listed (assign, access, hex, entropy_hex, entropy).

    Base spans always stay; an entropy span is added where it touches none of them. A null or empty text has an
    empty array. Rows are independent, so repeated rows get equal spans. A column named like ``spans`` is replaced.
    """
    body = F.col("_body")
    names = [c for c in docs.columns if c != spans]
    order = [k for k, *_ in BASE] + [c.kind for c in CLASSES]
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in order]), s["kind"])
    df = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_body"))
    base = F.concat(*[find_spans(body, pattern, kind, group, least) for kind, pattern, group, least in BASE])
    df = df.withColumn("_base", base)
    more = F.filter(
        entropy_spans(body), lambda e: ~F.exists("_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    )
    keyed = F.transform(
        F.concat("_base", more), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return df.withColumn(spans, ordered).select(*[F.col(f"`{c}`") for c in names], spans)


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``. ``spans`` are ordered by start."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["end"] + 1, s["start"] - acc["end"])
        apart = s["start"] >= acc["end"]
        return F.struct(
            F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["end"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, with every secret span of ``text`` replaced. Null texts stay null."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = scan_secrets(marked, text="_text", spans="_spans")
    clean = redact(F.col("_text"), F.col("_spans"), mark)
    return found.select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
