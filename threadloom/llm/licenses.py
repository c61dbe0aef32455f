"""License scans by patience alignment.

A text's words are aligned with a license template's: words that occur once in both are anchors, their longest
increasing subsequence is kept, and the gaps between anchors are aligned the same way. Coverage is the share of the
template's words that found a partner. Texts are whole; where a template may stand in a long text is found first, by
the places that enough of its words follow, so that words are unique there again and every occurrence counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# Notices of common licenses (family, text).
TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-2.0-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-notice": (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd-notice": (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "gpl-3-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-notice": (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-notice": (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
    ),
}
LEAST = 0.8
MEMORY = 4096  # different windows of a text whose alignment is remembered


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) in code points; words are compared without case."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal words, increasing in both: patience alignment. Works off a stack of gaps."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        kept = [anchors[n] for n in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        i0, j0 = a0, b0
        for i, j in [*kept, (a1, b1)]:
            gaps.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        out += kept
    return sorted(out)


class Scanner:
    """Templates made ready: their words, and words of which every match must hold one."""

    def __init__(self, templates: dict[str, tuple[str, str]], least: float = LEAST):
        self.least = least
        self.templates = []
        for name, (family, text) in sorted(templates.items()):
            found = [w for w, _, _ in words_of(text)]
            spare = len(found) - int(np.ceil(least * len(found) - 1e-9))
            rare = sorted(set(found), key=lambda w: (-len(w), w))
            held: list[str] = []
            for w in rare:  # words that stand for more than `spare` of the template's places: one of them must match
                held.append(w)
                if sum(found.count(x) for x in held) > spare:
                    break
            self.templates.append((name, family, found, held))

    def occurrences(self, template: list[str], doc: list[str]) -> list[tuple[int, int, int]]:
        """(pairs, first word, last word) of every occurrence of the template, by place.

        An occurrence starts at a word of the template and takes up to a fifth (1 - least) more words than the template
        has. Starts are aligned only where enough of the template's words, repeats counted, follow. If the longest window
        falls short, as words of another occurrence after it may, shorter ones are tried. Two that overlap by half of
        the shorter or more are one: that of more pairs, then fewer words, counts; words that it frees are searched again.
        """
        n = len(template)
        need, width = int(np.ceil(self.least * n - 1e-9)), n + int(n * (1 - self.least)) + 1
        want, have, bag, ahead = Counter(template), Counter(), 0, 0
        spots = [i for i, w in enumerate(doc) if w in want]
        known: dict[tuple[str, ...], tuple[int, int, int] | None] = {}

        def aligned(at: int, end: int) -> tuple[int, int, int] | None:
            window = tuple(doc[at:end])
            if window not in known:
                if len(known) >= MEMORY:
                    known.clear()
                pairs = align(template, list(window))
                known[window] = (len(pairs), pairs[0][1], pairs[-1][1]) if len(pairs) >= need else None
            found = known[window]
            return found and (found[0], at + found[1], at + found[2])

        def shorter(k: int, stop: int) -> tuple[int, int, int] | None:
            seen, held = Counter(), 0
            for i in spots[k:stop]:
                seen[doc[i]] += 1
                held += seen[doc[i]] <= want[doc[i]]
                if held >= need and (found := aligned(spots[k], i + 1)):
                    return found
            return None

        out: list[tuple[int, int, int]] = []
        freed: list[tuple[int, int]] = []
        for k, at in enumerate(spots):
            while ahead < len(spots) and spots[ahead] < at + width:
                have[doc[spots[ahead]]] += 1
                bag += have[doc[spots[ahead]]] <= want[doc[spots[ahead]]]
                ahead += 1
            done = out and out[-1][0] == out[-1][2] - out[-1][1] + 1 == n and 2 * (at - out[-1][1]) <= n
            found = None if bag < need or done else aligned(at, at + width) or shorter(k, ahead)
            if found and out and 2 * (out[-1][2] + 1 - found[1]) >= min(out[-1][2] - out[-1][1], found[2] - found[1]) + 1:
                old, out[-1] = out[-1], max(out[-1], found, key=lambda m: (m[0], m[1] - m[2], -m[1]))
                freed.append((max(old[1], out[-2][2] + 1 if len(out) > 1 else 0), out[-1][1]))
            elif found:
                out.append(found)
            bag -= have[doc[at]] <= want[doc[at]]
            have[doc[at]] -= 1
        for low, high in freed:
            if high - low >= need:
                out += [(pairs, low + a, low + b) for pairs, a, b in self.occurrences(template, doc[low:high])]
        return sorted(out, key=lambda m: m[1])

    def scan(self, text: str | None) -> list[dict]:
        """Matches (name, family, coverage, start, end) in code points, by start."""
        if not text:
            return []
        low = text.lower()
        wanted = [t for t in self.templates if any(w in low for w in t[3])]
        if not wanted:
            return []
        found = words_of(text)
        doc = [w for w, _, _ in found]
        out = []
        for name, family, template, _ in wanted:
            for pairs, a, b in self.occurrences(template, doc):
                coverage = round(pairs / len(template), 6)
                out.append({"name": name, "family": family, "coverage": coverage, "start": found[a][1], "end": found[b][2]})
        return sorted(out, key=lambda m: (m["start"], m["end"], m["name"]))


MATCHES = "array<struct<name:string,family:string,coverage:double,start:long,end:long>>"


def scan_licenses(
    docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, matches (name, family, coverage, start, end of every template covered by `least` or more) of every row.

    A narrow pass over whole texts. Null and empty texts have no matches; null and repeated ids are ordinary rows; an
    empty table gives no rows; other columns are dropped. Templates (a bounded set) travel with the function.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, least)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([scanner.scan(t) for t in part], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, MATCHES)(F.col(text_col)).alias("matches"))
