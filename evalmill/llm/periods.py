"""Periodic runs of words, found through string synchronising sets at dyadic scales.

A run is a stretch whose smallest period q fits at least twice and that no neighbouring word extends. Periods below
``SMALL`` are found directly, by comparing the words with themselves q places on. Larger ones are found scale by
scale: at scale t a place i is selected if, of the t-word windows that start in [i, i + t], the one with the smallest
hash starts at i or i + t. The choice depends on the next 2t words only, so two stretches with the same words select
the same places. A run of a period in [3t, 6t) has a selected place i in its first t places, and i + q is selected
with the same context: pairs of selected places with equal contexts propose periods.

Windows of a period of at most t / 3 are left out of the choice, or they would select everything. The stretches they
form are runs that the smaller scales have found already. A run that begins inside such a stretch is proposed by the
ends of two stretches, or, where two stretches of one period meet, by their phases. Proposals are extended by binary
search on hashes and then compared word by word.

All documents of a slice are searched at once: a word of its own stands between them, which no run can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.texts import bounds, slices, split_words

#: Periods up to this one are found directly; 3t - 1 for the first scale t = 16.
SMALL = 47
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of every number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all windows of a sequence, from running sums modulo 2**64. Equal windows have equal hashes.

    ``codes`` are the mixed bits of every number, where few numbers occur.
    """

    def __init__(self, words: np.ndarray, codes: np.ndarray | None = None):
        steps = np.full(len(words) + 1, BASE, dtype=np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.back = np.cumprod(steps)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum((mixed(words) if codes is None else codes[words]) * powers[:-1], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.back[: len(self.sums) - size]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def merged(found: list[Runs]) -> Runs:
    """Each stretch once, with its smallest period, by start and then period."""
    start, end, period = (np.concatenate([f[n] for f in found]) for n in range(3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def direct_runs(words: np.ndarray, period: int, least: int) -> Runs:
    """Maximal stretches with this period (maybe not their smallest)."""
    same = np.flatnonzero(words[:-period] == words[period:])
    if not len(same):
        return same, same, same
    cut = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate([[0], cut + 1])]
    last = same[np.concatenate([cut, [len(same) - 1]])]
    good = last - first + 1 >= max(period, least - period)
    first, last = first[good], last[good]
    return first, last + 1 + period, np.full(len(first), period, dtype=np.int64)


def smallest_within(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbouring values."""
    held, out = 1, values
    while held < size:
        step = min(held, size - held)
        out = np.minimum(out[:-step], out[step:])
        held += step
    return out


def synchronising_set(hashes: Hashes, n: int, scale: int, known: Runs) -> np.ndarray:
    """Selected places at a scale; windows inside the known runs of a period of at most scale / 3 take no part."""
    ids = mixed(hashes.windows(scale))
    start, end, period = known
    inside = (3 * period <= scale) & (end - start >= scale)
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(edge, start[inside], 1)
    np.add.at(edge, end[inside] - scale + 1, -1)
    ids[np.cumsum(edge[:-1]) > 0] = NONE
    low = smallest_within(ids, scale + 1)
    first, last = ids[: len(low)], ids[scale : scale + len(low)]
    return np.flatnonzero((low != NONE) & ((first == low) | (last == low)))


def close_pairs(places: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of sorted places with a distance in [low, high)."""
    step = 1
    while step < len(places):
        gap = places[step:] - places[:-step]
        if (gap >= high).all():
            break
        near = np.flatnonzero((gap >= low) & (gap < high))
        yield near, near + step
        step += 1


def proposals(hashes: Hashes, n: int, scale: int, known: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) with period in [3 scale, 6 scale): the words at place and place + period may lie in one run."""
    low, high = 3 * scale, 6 * scale
    places = synchronising_set(hashes, n, scale, known)
    context = hashes.at(places, places + 2 * scale)
    found = []
    for a, b in close_pairs(places, low, high):
        same = context[a] == context[b]
        found.append((places[a[same]], places[b[same]] - places[a[same]]))
    start, end, period = known
    long = (3 * period <= scale) & (end - start >= 3 * scale - 1)
    start, end, period = start[long], end[long], period[long]
    ends = np.sort(end)
    for a, b in close_pairs(ends, low, high):
        found.append((ends[a] - 1, ends[b] - ends[a]))
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    meet = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
    for i in meet:
        p = period[i]
        turns = start[i + 1] + np.arange(p)
        fits = np.flatnonzero(hashes.at(turns, turns + p) == hashes.at(start[i : i + 1], start[i : i + 1] + p))
        if len(fits):
            phase = (turns[fits[0]] - start[i]) % p
            q = np.arange(low + (phase - low) % p, high, p)
            x = np.maximum(start[i], start[i + 1] - q)
            good = x < np.minimum(end[i], end[i + 1] - q)
            found.append((x[good], q[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def same_length(hashes: Hashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray, longest: int, back: bool = False) -> np.ndarray:
    """How many words from a and from b on (or before them) are equal, by hashes; at most ``limit``."""
    out = np.zeros(len(a), dtype=np.int64)
    step = 1 << max(longest, 1).bit_length()
    while step:
        more = out + step
        may = np.flatnonzero(more <= limit)
        if back:
            same = hashes.at(a[may] - more[may], a[may] - out[may]) == hashes.at(b[may] - more[may], b[may] - out[may])
        else:
            same = hashes.at(a[may] + out[may], a[may] + more[may]) == hashes.at(b[may] + out[may], b[may] + more[may])
        out[may[same]] += step
        step >>= 1
    return out


def exact_reach(words: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """The maximal stretch with this period around a place, word by word."""
    a, b = place, place
    while b + period < len(words) and words[b] == words[b + period]:
        b += 1
    while a > 0 and words[a - 1] == words[a - 1 + period]:
        a -= 1
    return a, b + period


def extended(words: np.ndarray, hashes: Hashes, place: np.ndarray, period: np.ndarray, longest: int, least: int) -> Runs:
    """The proposals that are stretches of two periods and ``least`` words at least, once each, compared word by word."""
    n = len(words)
    ahead = same_length(hashes, place, place + period, n - place - period, longest)
    behind = same_length(hashes, place, place + period, place, longest, back=True)
    good = (ahead + behind >= period) & (ahead + behind + period >= least)
    rows = np.unique(np.stack([place - behind, place + ahead + period, period, place])[:, good], axis=1)
    start, end, period, place = rows
    first = np.ones(len(start), dtype=bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0) | (np.diff(period) != 0)
    kept = []
    for s, e, q, x in zip(start[first], end[first], period[first], place[first]):
        if not np.array_equal(words[s : e - q], words[s + q : e]):
            s, e = exact_reach(words, x, q)
        if e - s >= max(2 * q, least):
            kept.append((s, e, q))
    rows = np.array(kept, dtype=np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def joined(flat: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen documents one after another with a word of its own behind each, and the shift of each to its old places."""
    lengths = np.diff(ends)[chosen]
    starts = bounds(lengths + 1)
    out = np.empty(starts[-1], dtype=np.int64)
    shift = ends[:-1][chosen] - starts[:-1]
    body = np.arange(starts[-1])
    last = np.zeros(starts[-1], dtype=bool)
    last[starts[1:] - 1] = True
    out[~last] = flat[(body + np.repeat(shift, lengths + 1))[~last]]
    out[last] = -1 - np.arange(len(chosen))
    return out, starts


def find_runs(flat: np.ndarray, counts: np.ndarray, least: int = 12, small: int = SMALL) -> tuple[np.ndarray, Runs]:
    """Document, and start, end and period of every run of at least ``least`` words, by document, start and period.

    ``flat`` numbers the words (from 0) of all documents one after another, ``counts`` says how many each has.
    ``small`` + 1 is three times a power of two.
    """
    ends = bounds(counts)
    everyone = np.flatnonzero(counts >= max(2, least))
    words, starts = joined(flat, ends, everyone)
    longest = int(counts.max(initial=0))
    scale = (small + 1) // 3
    own = min(least, scale)  # the scales build on shorter runs too
    narrow = words.astype(np.int32) if len(words) < 1 << 31 else words
    found = [(np.zeros(0, np.int64),) * 3]
    for q in range(1, min(small, longest // 2) + 1):
        found.append(direct_runs(narrow, q, own))
    known = merged(found)
    # places in the joined words of the scale at hand are moved to those of all documents, and back
    while 6 * scale <= longest:
        chosen = np.flatnonzero(counts[everyone] >= 6 * scale)
        part, part_starts = joined(flat, ends, everyone[chosen])
        move = starts[:-1][chosen] - part_starts[:-1]
        doc = np.searchsorted(starts, known[0], side="right") - 1
        at = np.searchsorted(chosen, doc)
        held = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == doc)
        here = [known[0][held] - move[at[held]], known[1][held] - move[at[held]], known[2][held]]
        hashes = Hashes(part)
        place, period = proposals(hashes, len(part), scale, tuple(here))
        s, e, q = extended(part, hashes, place, period, longest, own)
        back = move[np.searchsorted(part_starts, s, side="right") - 1]
        known = merged([known, (s + back, e + back, q)])
        scale *= 2
    start, end, period = known
    good = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[good], end[good], period[good]
    doc = np.searchsorted(starts, start, side="right") - 1
    first = starts[:-1][doc]
    return everyone[doc], (start - first, end - first, period)


def kept_words(counts: np.ndarray, doc: np.ndarray, runs: Runs) -> np.ndarray:
    """Which words stay when every run is cut down to its first period. A word goes if any run says so."""
    start, end, period = runs
    ends = bounds(counts)
    edge = np.zeros(ends[-1] + 1, dtype=np.int32)
    np.add.at(edge, ends[doc] + start + period, 1)
    np.add.at(edge, ends[doc] + end, -1)
    return np.cumsum(edge[:-1]) == 0


def collapse_slice(texts: pa.Array, least: int, small: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of a slice."""
    flat, counts = split_words(texts, lower=False)
    numbers = np.asarray(flat.combine_chunks().dictionary_encode().indices if isinstance(flat, pa.ChunkedArray) else flat.dictionary_encode().indices)
    doc, (start, end, period) = find_runs(numbers, counts, least, small)
    offsets = bounds(np.bincount(doc, minlength=len(counts))).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, end - start, period)], ["start", "length", "period"])
    keep = kept_words(counts, doc, (start, end, period))
    owner = np.repeat(np.arange(len(counts)), counts)
    left = flat.filter(pa.array(keep))
    lists = pa.LargeListArray.from_arrays(pa.array(bounds(np.bincount(owner[keep], minlength=len(counts)))), left)
    text = pc.binary_join(lists, pa.scalar(" ", left.type)).cast(pa.large_string())
    return pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items), text


SCHEMA = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12, small: int = SMALL) -> DataFrame:
    """A row per document: ``row`` (all its columns, as a struct), n_words, runs and collapsed.

    Words end at ASCII white space. ``runs`` lists every maximal run of at least ``least`` words by start, then period;
    ``collapsed`` are the words without those that any run holds after its first period, joined by blanks. Null and
    empty texts have no words, no runs and an empty collapsed text. Equal rows give equal rows; other columns may have
    any name, as they stay inside ``row``. Documents are searched in slices of 4 MB, a longer one alone.
    """
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                counts, runs, left = collapse_slice(part.column("body"), least, small)
                yield pa.RecordBatch.from_arrays([part.column("row"), counts, runs, left], ["row", "n_words", "runs", "collapsed"])

    kind = work.schema["row"].dataType.simpleString()
    return work.mapInArrow(run, f"row {kind}, {SCHEMA}")
