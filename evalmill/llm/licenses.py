"""License scans with built-in functions only: lines and paragraphs against templates by Dice over word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as their publishers word them: license id, then its template texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}

HITS = "array<struct<license:string,dice:double>>"


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text: lower case, runs of anything but a-z and 0-9 as one blank."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def pairs(held: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(held) - 1), lambda i: F.concat_ws(" ", F.get(held, i - 1), F.get(held, i)))
        return F.when(F.size(held) > 1, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def template_table(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(license, bigrams) of every template, by the same normalising."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
            out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def gate_words(table: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which any matching segment holds one.

    A match holds at least n*t/(2-t) of a template's n bigrams, so it meets every set of more than the rest of
    them. Long words are taken first, until the bigrams that hold a taken word are such a set in every template.
    """
    need = {i: len(g) - math.ceil(len(g) * threshold / (2 - threshold) - 1e-9) + 1 for i, (_, g) in enumerate(table)}
    left = {i: set(g) for i, (_, g) in enumerate(table)}
    taken: list[str] = []
    while open_now := {i for i, n in need.items() if n > 0}:
        gain: dict[str, int] = {}
        for i in open_now:
            for gram in left[i]:
                for w in set(gram.split()):
                    gain[w] = gain.get(w, 0) + (len(w) ** 3 if len(w) > 4 else 0.01)
        word = min(gain, key=lambda w: (-gain[w], w))
        taken.append(word)
        for i in open_now:
            hit = {g for g in left[i] if word in g.split()}
            left[i] -= hit
            need[i] -= len(hit)
    return taken


def scan_licenses(docs: DataFrame, threshold: float = 0.8, text: str = "text", hits: str = "license_hits", templates=TEMPLATES) -> DataFrame:
    """Add ``hits``: array of (license, dice), the best dice of every license found, by license.

    Lines and paragraphs (runs between empty lines) are compared. dice = 2 * common / (size + template size) over
    distinct bigrams; ``threshold`` in (0, 1]. A template is compared only where its size allows the threshold,
    the segment holds a gate word and enough bigrams of any template at all: no bound loses a match. Null, empty and
    one-word texts have no hits. A column named like ``hits`` is replaced.
    """
    table = template_table(templates)
    every = F.array(*[F.lit(b) for b in sorted({b for _, grams in table for b in grams})])
    low = min(len(g) for _, g in table) * threshold / (2 - threshold)
    high = max(len(g) for _, g in table) * (2 - threshold) / threshold
    names = [c for c in docs.columns if c != hits]
    body = F.coalesce(F.col("_body"), F.lit(""))
    words = gate_words(table, threshold)

    def gate(value: Column) -> Column:
        return reduce(or_, [F.contains(value, F.lit(w)) for w in words])

    def parts(low: Column) -> Column:
        both = F.concat(F.split(low, "\n"), F.split(low, "\n[\\x20\\t\\r]*\n"))
        return F.when(gate(low), F.array_distinct(F.filter(both, gate))).otherwise(F.array().cast("array<string>"))

    segments = F.get(F.transform(F.array(F.lower(body)), parts), F.lit(0))

    def judge(segment: Column) -> Column:
        def against(s: Column) -> Column:
            size, common = F.size(s["grams"]), F.size(s["known"])
            found = []
            for name, grams in table:
                n = len(grams)
                possible = (size * (2 - threshold) >= n * threshold) & (size * threshold <= n * (2 - threshold)) & (2 * common >= threshold * (size + n))
                dice = 2 * F.size(F.array_intersect(s["known"], F.array(*[F.lit(g) for g in grams]))) / (size + n)
                found.append(F.when(possible, F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
            return F.filter(F.array(*found), lambda h: h["dice"] >= threshold)

        def known(grams: Column) -> Column:
            fits = (F.size(grams) >= low) & (F.size(grams) <= high)
            both = F.struct(grams.alias("grams"), F.array_intersect(grams, every).alias("known"))
            held = F.get(F.transform(F.array(both), lambda s: F.when(2 * F.size(s["known"]) >= threshold * F.size(grams), against(s))), F.lit(0))
            return F.when(fits, held)

        return F.coalesce(F.get(F.transform(F.array(bigrams(segment)), known), F.lit(0)), F.array().cast(HITS))

    found = F.array_sort(F.flatten(F.transform(segments, judge)))
    found_col = F.col("_found")
    best = F.filter(found_col, lambda h, i: F.coalesce(F.get(found_col, i + 1)["license"] != h["license"], F.lit(True)))
    df = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_body")).withColumn("_found", found)
    return df.select(*[F.col(f"`{c}`") for c in names], best.alias(hits))
