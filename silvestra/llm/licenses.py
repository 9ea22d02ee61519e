"""License scans by patience alignment of texts with license templates.

Words are lower-case runs of letters, digits and inner ``. - +`` signs. A template and a stretch of
text are aligned on the words that occur once in both: the longest increasing subsequence of these
anchors is taken, and the gaps between them are aligned in the same way. A gap without such words
matches what its two ends have in common, and the rest by a longest common subsequence, taken as the
longest increasing subsequence of all equal word pairs. Coverage is the share of the template's words
that are matched.

A stretch is tried wherever the template's telling words lie close together: neighbours at most a
template's length apart, with a template's length on both sides. A first look per text, over all of
its words, drops templates of which too few words occur at all for the coverage; it can't drop a
match. Within a stretch the matches are split where more than a template's length of other words lies
between them, and the best part counts.

A match must hold the phrases of ``MUST``, each word next to the other: names and versions that tell
a license from others of nearly the same words.

A row comes out for each document and license with a coverage of ``MIN_COVERAGE`` and matches that
fill ``MIN_DENSITY`` of the words they span. Defined results: null or empty texts, and texts without
a license, give no row; rows that repeat each give their own; of equally good stretches the first
counts. Extra columns of any name are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MIN_COVERAGE, MIN_DENSITY = 0.8, 0.6
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-2.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "BSD": "Released under the BSD License",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "BSL-1.0-full": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
} | {x.name[:-4]: x.read_text() for x in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")}
#: Phrases, by template, that a match must hold as they are.
MUST = {
    "Apache-2.0": ("apache", "2.0"), "Apache-2.0-notice": ("apache", "2.0"), "CC-BY-NC-4.0": ("by-nc", "4.0"), "CC-BY-4.0": ("creative commons attribution 4.0",), "MIT": ("mit",), "BSD": ("bsd",),
    "GPL-3.0": ("gnu general public license", "version 3"), "GPL-2.0-notice": ("gnu general public license", "version 2"), "GPL-3.0-notice": ("gnu general public license", "version 3"), "GPL-3.0-full": ("gnu general public license version 3",),
    "AGPL-3.0-notice": ("gnu affero general public license", "version 3"), "LGPL-2.1-notice": ("gnu lesser general public license", "version 2.1"), "LGPL-3.0-notice": ("gnu lesser general public license", "version 3"),
    "MPL-2.0-notice": ("mozilla", "2.0"), "EPL-2.0-notice": ("eclipse", "2.0"), "BSL-1.0-notice": ("boost", "1.0"),
}
#: Templates of more words get no look at single words beforehand, only at the text's length.
LONG = 500
#: Words too common to begin a stretch.
COMMON = frozenset("a all and any are as at be by for from in is it may must not of on or that the this to under with without you use work files file version list".split())
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence that rises in both, of pairs sorted by the first, then the second descending."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at:
            back[k] = ends[at - 1]
        if at == len(tails):
            tails.append(b)
            ends.append(k)
        else:
            tails[at], ends[at] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a[w] == 1}
        anchors = increasing([(x, place[a[x]]) for x in range(i, j) if a[x] in place])
        if not anchors:
            while i < j and k < m and a[i] == b[k]:
                out.append((i, k))
                i, k = i + 1, k + 1
            while i < j and k < m and a[j - 1] == b[m - 1]:
                j, m = j - 1, m - 1
                out.append((j, m))
            places: dict[str, list[int]] = {}
            for x in range(m - 1, k - 1, -1):
                places.setdefault(b[x], []).append(x)
            out += increasing([(x, y) for x in range(i, j) for y in places.get(a[x], ())])
            continue
        out += anchors
        for (i0, k0), (i1, k1) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            todo.append((i0 + 1, i1, k0 + 1, k1))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name, self.words = name, words_of(text)
        self.counts = Counter(self.words)
        self.telling = {w for w in self.words if w not in COMMON} or set(self.words)
        runs = [p.split() for p in MUST.get(name, ())]
        self.must = [range(k, k + len(r)) for r in runs for k in [x for x in range(len(self.words)) if self.words[x : x + len(r)] == r][:1]]

    def told(self, part: list[tuple[int, int]]) -> bool:
        """Whether these matched places (in the text, in the template) hold the template's phrases."""
        at = {k: x for x, k in part}
        return all(k in at and at[k] - at.get(run[0], -1) == k - run[0] for run in self.must for k in run)

    def stretches(self, places: dict[str, list[int]], n: int) -> list[tuple[int, int]]:
        """Where its telling words lie close together, with a margin; disjoint and in order."""
        at, size = sorted(x for w in self.telling for x in places.get(w, ())), len(self.words)
        out: list[tuple[int, int]] = []
        for x in at:
            if out and x - out[-1][1] <= size:
                out[-1] = (out[-1][0], x)
            else:
                out.append((x, x))
        return [(max(0, i - size), min(n, j + size + 1)) for i, j in out]

    def best(self, text: list[str], places: dict[str, list[int]], coverage: float, density: float) -> tuple[float, int, int] | None:
        """Coverage, first word and end of the best part that passes."""
        size, found = len(self.words), None
        if len(text) < coverage * size - 1e-9 or any(self.words[k] not in places for run in self.must for k in run):
            return None
        if sum(min(c, len(places.get(w, ()))) for w, c in self.counts.items()) < coverage * size - 1e-9:
            return None
        for lo, hi in self.stretches(places, len(text)):
            own = [w for w in text[lo:hi] if w in self.counts]
            have = Counter(own)
            if sum(min(c, have[w]) for w, c in self.counts.items()) < coverage * size - 1e-9:
                continue
            matched, part = [(lo + i, k) for i, k in align(text[lo:hi], self.words)], []
            for x in [*matched, None]:
                if part and (x is None or x[0] - part[-1][0] > size):
                    share, first, end = round(len(part) / size, 6), part[0][0], part[-1][0] + 1
                    if share >= coverage and len(part) / (end - first) >= density and (found is None or share > found[0]) and self.told(part):
                        found = (share, first, end)
                    part = []
                if x is not None:
                    part.append(x)
        return found


def licenses_in(text: str | None, templates: list[Template], coverage: float = MIN_COVERAGE, density: float = MIN_DENSITY) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end) of each license found."""
    if not text:
        return []
    words = words_of(text)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        places.setdefault(w, []).append(k)
    found = ((t.name, t.best(words, places, coverage, density)) for t in templates)
    return [(name, *hit) for name, hit in found if hit]


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = MIN_COVERAGE, density: float = MIN_DENSITY) -> DataFrame:
    """doc_id, license, coverage, start, stop (words from 0, stop excluded); one pass, no exchange.

    The JVM drops texts that hold no telling word of any template as a substring, and are shorter than the
    least that a long template needs; they can't match.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(n, t) for n, t in templates.items()]
        for batch in batches:
            rows = [(i, *hit) for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in licenses_in(x.as_py(), made, coverage, density)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "license", "coverage", "start", "stop"])

    sizes = {n: sorted(map(len, words_of(t))) for n, t in templates.items()}
    least = [sum(x[: int(coverage * len(x))]) for x in sizes.values() if len(x) > LONG]
    low, some = F.lower("text"), F.length("text") >= min(least) if least else F.lit(False)
    for w in sorted(required({n: t for n, t in templates.items() if len(sizes[n]) <= LONG}, coverage)):
        some = some | F.contains(low, F.lit(w))
    return docs.select(F.col("doc_id").cast("long"), "text").where(some).mapInArrow(run, "doc_id long, license string, coverage double, start int, stop int")


def required(templates: dict[str, str], coverage: float = MIN_COVERAGE) -> set[str]:
    """Words of which each match holds at least one: of each template the longest telling ones, more than may be missing."""
    out: set[str] = set()
    for name, text in templates.items():
        t = Template(name, text)
        spare = int((1 - coverage) * len(t.words) + 1e-9)
        chosen, weight = [], 0
        for w in sorted(t.telling, key=lambda w: (w not in out, -len(w), w)):
            chosen.append(w)
            weight += t.counts[w]
            if weight > spare:
                break
        out |= set(chosen) if weight > spare else set(t.words)
    return out


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
