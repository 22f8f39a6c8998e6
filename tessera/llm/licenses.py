"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences. Of every ``WINNOW`` successive ``GRAM``-word hashes of a
template the least is kept, and an inverted index maps it to (template, place). The
index has a fixed size and is broadcast. A document is hashed whole, in one vectorised
pass; only documents that hit the index go on. Hits of a template on near diagonals form
a candidate, which is aligned to the template within a band (match +2, other -1, local);
the candidate is reported if enough of the template's words match, with its span. Of
overlapping candidates that are variants of one licence, the one that fits best counts.
The list of templates is fixed: notices it lacks, SPDX lines among them, are not reported.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S

GRAM = 3
WINNOW = 3
#: Least share of a template's words that must match.
COVERAGE = 0.7

#: Well-known licence notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "MIT-line": "Released under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
        more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "BSD-3-Clause-names": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

#: Variants of one licence: near the same words, of which the few that differ decide.
FAMILIES = dict.fromkeys(("GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0"), "GNU")
#: Templates so short that all their words must match.
WHOLE = set()
for _kind, _long in {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES.setdefault(f"CC-{_kind}-{_version}", f"This work is licensed under a Creative Commons Attribution{_long} {_version} {_scope} License.")
        FAMILIES[f"CC-{_kind}-{_version}"] = "CC"
    for _version in ("4.0", "3.0", "2.5", "2.0", "1.0", ""):
        _name = f"CC-{_kind}{'-' * bool(_version)}{_version}-line"
        TEMPLATES[_name] = f"Licensed under CC {_kind} {_version}".rstrip()
        FAMILIES[_name] = "CC"
        WHOLE.add(_name)

_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(text: str) -> list[tuple[str, int, int]]:
    """Words with ASCII letters in lower case, and their spans."""
    return [(m[0].translate(_LOWER), m.start(), m.end()) for m in _WORD.finditer(text)]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _grams(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) < GRAM:
        return np.zeros(0, np.uint64)
    joined = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        joined += hashes[k : k + len(joined)] * S._MULT[k]
    return S.mix(joined)


def gram_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, _ = S.word_hashes(data, np.array([0, len(data)]), _BREAK)
    return _grams(hashes)


def winnow(hashes: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the least hash (the last of equals) of each window; the least of all if there is no whole window."""
    if len(hashes) <= window:
        return [int(np.flatnonzero(hashes == hashes.min())[-1])] if len(hashes) else []
    kept: list[int] = []
    for at in range(len(hashes) - window + 1):
        part = hashes[at : at + window]
        place = at + int(np.flatnonzero(part == part.min())[-1])
        if not kept or kept[-1] != place:
            kept.append(place)
    return kept


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [[w for w, _, _ in words(t)] for t in templates.values()]
        places: dict[int, list[tuple[int, int]]] = {}
        for k, text in enumerate(templates.values()):
            hashes = gram_hashes(text)
            for place in winnow(hashes):
                places.setdefault(int(hashes[place]), []).append((k, place))
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(key)] for key in self.keys]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places in ``grams`` that the index has."""
        if not len(self.keys) or not len(grams):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] == grams)

    def find(self, text: str, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
        """``(template, share of its words matched, words matched, start, end)`` of each candidate that passes."""
        found_words = words(text)
        grams = gram_hashes(text)
        diagonals: dict[int, list[tuple[int, int]]] = {}
        for at in self.hits(grams):
            for k, place in self.places[int(np.searchsorted(self.keys, grams[at]))]:
                diagonals.setdefault(k, []).append((int(at) - place, int(at)))
        out, missing = [], []
        for k, hits in sorted(diagonals.items()):
            template = self.words[k]
            band = 4 + len(template) // 8
            hits.sort()
            group = [hits[0]]
            for hit in [*hits[1:], None]:
                if hit is not None and hit[0] - group[-1][0] <= band:
                    group.append(hit)
                    continue
                low, high = group[0][0], group[-1][0]
                left, right = max(0, low - band), min(len(found_words), high + len(template) + band)
                matched, first, last = align(template, [w for w, _, _ in found_words[left:right]], low - left, high - left, band)
                if matched >= (1 if self.names[k] in WHOLE else coverage) * len(template):
                    missing.append(len(template) - matched)
                    out.append((self.names[k], round(matched / len(template), 6), matched, found_words[left + first][1], found_words[left + last][2]))
                group = [hit]
        return _best_variants(sorted(zip(out, missing, strict=True), key=lambda x: (x[0][3], x[0][4], x[0][0])))


def _best_variants(found: list[tuple[tuple, int]]) -> list[tuple]:
    """``(candidate, words missing)`` in order of start -> candidates without those that overlap a better kept one of their family."""
    rank = [(lost, -x[2]) for x, lost in found]
    over: list[list[int]] = [[] for _ in found]
    for a, (x, _) in enumerate(found):
        family = FAMILIES.get(x[0])
        for b in range(a + 1, len(found) if family else 0):
            if found[b][0][3] >= x[4]:
                break
            if FAMILIES.get(found[b][0][0]) == family:
                over[a].append(b)
                over[b].append(a)
    beaten: set[int] = set()
    for a in sorted(range(len(found)), key=rank.__getitem__):
        if a not in beaten:
            beaten.update(b for b in over[a] if rank[b] > rank[a])
    return [x for a, (x, _) in enumerate(found) if a not in beaten]


def align(template: list[str], part: list[str], low: int, high: int, band: int) -> tuple[int, int, int]:
    """``(words matched, first, last)`` of the best local alignment between diagonals ``low - band`` and ``high + band``."""
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low - band), min(len(part), i + high + band + 1)):
            score, matched, start = before.get(j - 1, (0, 0, j))
            if word == part[j]:
                cell = (score + 2, matched + 1, start) if score > 0 else (2, 1, j)
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j)
            else:
                cell = (score - 1, matched, start)
            for other in (before.get(j), now.get(j - 1)):
                if other is not None and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                now[j] = cell
        before = now
    return best[1:]


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, matched, start, end``: a row per template found in a document.

    ``start`` and ``end`` count code points, end exclusive. Defined cases: null, empty and
    word-less texts give no row; repeated rows give repeated rows; a null id is reported as
    null; templates that overlap in a text are all reported, but of variants of one licence
    (``FAMILIES``) only the best; an empty table gives no rows;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows = []
            for row, data, offsets in S.text_chunks(column):
                hashes, first = S.word_hashes(data, offsets, _BREAK)
                hit = index.hits(_grams(hashes))  # a gram over a border between documents only costs a look
                for k in np.unique(np.searchsorted(first, hit, "right") - 1):
                    rows += [(ids[row + k].as_py(), *found) for found in index.find(column[row + int(k)].as_py(), coverage)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "matched", "start", "end"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, license string, coverage double, matched int, start int, end int")
