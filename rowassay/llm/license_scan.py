"""License scan: patience alignment of templates with the words of each document.

Words that are unique on both sides anchor a template; the longest increasing run of anchors is
kept, and the gaps between them are aligned the same way. Coverage is the share of the template's
words that found their place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.shared import sliced

#: The usual wording of public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-2-Clause-title": "BSD 2-Clause License",
    "BSD-3-Clause-title": "BSD 3-Clause License",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
        "domain worldwide. This software is distributed without any warranty."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}
COVERAGE = 0.8
#: A tag that names licenses; AND, OR, WITH and brackets join the names.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)")
JOINED = re.compile(r"[ \t()]+")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def keys_of(template: Sequence[str], common: Counter, coverage: float) -> frozenset[str]:
    """The template's rarest words that fill more places than may stay uncovered: a document that
    reaches the coverage holds at least one of them."""
    out: set[str] = set()
    places = Counter(template)
    for word in sorted(places, key=lambda w: (len(w) < 3, common[w], -len(w), w)):
        out.add(word)
        if sum(places[w] for w in out) > (1 - coverage) * len(template) + 1e-9:
            break
    return frozenset(out)


def increasing(values: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing run, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = at[pile - 1]
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: Sequence[str], b: Sequence[str], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of a patience alignment of a[alo:ahi] with b[blo:bhi]."""
    out: list[tuple[int, int]] = []
    todo = [(alo, ahi, blo, bhi)]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {a[i]: i for i in range(alo, ahi) if in_a[a[i]] == 1}
        unique = [(place[b[j]], j) for j in range(blo, bhi) if in_b[b[j]] == 1 and b[j] in place]
        chain = [unique[k] for k in increasing([i for i, _ in unique])]
        if not chain:
            continue
        out += chain
        ends = [(alo - 1, blo - 1), *chain, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def windows(words: Sequence[str], template: Sequence[str], keys: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Parts of the text that may hold the template: around runs of its keys.

    A run ends where the next key is further away than the template is long, or where a key comes
    more often than in the template: there the next copy begins.
    """
    size, most = len(template), Counter(template)
    begin = end = -1
    seen: Counter[str] = Counter()
    for at, word in enumerate(words):
        if word not in keys:
            continue
        if begin >= 0 and (at - end > size or seen[word] >= most[word]):
            yield begin, end
            seen.clear()
            begin = -1
        if begin < 0:
            begin = at
        seen[word] += 1
        end = at
    if begin >= 0:
        yield begin, end


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in templates.items()}
        common = Counter(w for t in self.templates.values() for w in t)
        self.keys = {name: keys_of(t, common, coverage) for name, t in self.templates.items()}

    def pattern(self) -> str:
        """Finds every text that can reach the coverage of any template."""
        return "(?iu)" + "|".join(sorted({"spdx", *(re.escape(w) for keys in self.keys.values() for w in keys)}))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, coverage) of each occurrence, in the order of the text."""
        words = words_of(text)
        present = set(words)
        out = []
        for name, template in self.templates.items():
            if not (present & self.keys[name]):
                continue
            reached = 0
            for first, last in windows(words, template, self.keys[name]):
                lo, hi = max(reached, first - len(template)), min(len(words), last + 1 + len(template))
                pairs = aligned(words, template, lo, hi, 0, len(template))
                pairs = tight(pairs, len(template))
                if pairs and len(pairs) >= self.coverage * len(template) - 1e-9:
                    out.append((name, pairs[0][0], pairs[-1][0] + 1, len(pairs) / len(template), len(pairs)))
                    reached = pairs[-1][0] + 1
        return outermost(out + tags(text))


def tags(text: str) -> list[tuple[str, int, int, float, int]]:
    """The names in SPDX tags, each at its own words."""
    out = []
    places: list[int] = []
    for tag in TAG.finditer(text):
        places = places or [m.start() for m in WORD.finditer(text)]
        at = tag.start(1)
        for name in JOINED.split(tag[1]):
            at = text.index(name, at)
            if name and name not in ("AND", "OR", "WITH"):
                first, end = bisect_left(places, at), bisect_left(places, at + len(name))
                out.append((name, first, end, 1.0, end - first))
            at += len(name)
    return out


def outermost(found: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """What lies in no longer occurrence; of equal places the one with most words found (last value), then coverage, then by name."""
    out, end = [], -1
    for x in sorted(found, key=lambda x: (x[1], -x[2], -x[4], -x[3], x[0])):
        if x[2] > end:
            out.append(x[:4])
            end = x[2]
    return out


def tight(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The longest run of pairs whose neighbours stand about as far apart in both."""
    best: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for i, j in pairs:
        if run and (i - run[-1][0]) > 2 * (j - run[-1][1]) + 3:
            run = []
        run.append((i, j))
        if len(run) > len(best):
            best = list(run)
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_licenses, licenses (license, start, end, coverage; places in words).

    Whole texts are read; a text without any key word of a template cannot reach the coverage and
    is not aligned. A notice inside the text of a longer license is part of that. Null and empty texts, and texts without a license, have an empty list. Repeated
    rows each get their row, null ids stay null, an empty table gives no rows.
    """
    chosen = templates or TEMPLATES
    kind = docs.schema[id_column].dataType.simpleString()
    found = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in sliced(batches):
            rows = [[dict(zip(("license", "start", "end", "coverage"), x, strict=True)) for x in scanner.scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int32()), pa.array(rows, found)], names=[id_column, "n_licenses", "licenses"])

    text = F.col(text_column).cast("string")
    may = F.when(text.rlike(Scanner(chosen, coverage).pattern()), text)
    return docs.select(F.col(id_column), may.alias("__text")).mapInArrow(run, f"`{id_column}` {kind}, n_licenses int, licenses array<struct<license: string, start: bigint, end: bigint, coverage: double>>")
