"""License scans: winnowed template fingerprints, an inverted index, banded alignment.

Templates are cut into word k-grams and winnowed (the least hash of every window stays); the index
from hash to (template, place) is small and fixed, so it travels with the task and documents are
scanned where they are read, without a shuffle. Hits of one template that lie near one diagonal make
a candidate; a banded alignment of the whole template against that stretch of the document gives the
matched words, their coverage and the span. Stretches that don't suffice alone are chained: what their
hits anchor counts, in the order of the template, however much text lies between.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, rows_of, slices, tool

GRAM, WINDOW, BAND = 3, 2, 12
#: Share of a template's words that must be aligned; one-line notices (few words) must be there word by word.
LEAST_COVERAGE, SHORT = 0.7, 16
#: Bytes of the memo table of a worker.
MEMO_BYTES = 32 << 20

#: Wording of public licences and of the notices that name them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "LGPL-2.1": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1"),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MIT-0": ("SPDX-License-Identifier: MIT-0",),
}

WORD = re.compile(r"[^\W_]+")
FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())])


@lru_cache(maxsize=1)
def _hash() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, MEMO_BYTES)


def grams(words: list[str], k: int = GRAM) -> np.ndarray:
    """Hashes of the k-grams of a word list, in order; fewer than k words give none."""
    h = np.fromiter(map(_hash().__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + len(out)]
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash (the last of equals) of every window of consecutive hashes."""
    n = len(hashes)
    if n <= window:
        return list(range(n))
    return sorted({max(range(i, i + window), key=lambda j: (-int(hashes[j]), j)) for i in range(n - window + 1)})


def align(template: list[str], words: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last place in ``words``) of the best alignment within a band."""
    pairs = matches(template, words, shift, band)
    return (len(pairs), pairs[0][1], pairs[-1][1]) if pairs else (0, -1, -1)


def matches(template: list[str], words: list[str], shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """(place in the template, place in ``words``) of the words of the best alignment within a band, in order.

    Template word i may meet words[i + shift + d] for |d| <= band; the most matches win, skipping is free
    on either side.
    """
    m, width = len(template), 2 * band + 1
    score = np.zeros((m + 1, width + 1), np.int32)  # score[i][d]: template[:i] against words[: i + shift + d - band]
    for i in range(1, m + 1):
        now, before, word = score[i], score[i - 1], template[i - 1]
        for d in range(width):
            at = i - 1 + shift + d - band
            best = max(before[d + 1], now[d - 1] if d else 0)
            if 0 <= at < len(words) and words[at] == word:
                best = max(best, before[d] + 1)
            now[d] = best
    i, d, out = m, int(score[m][:width].argmax()), []
    while i > 0 and d >= 0 and score[i][d] > 0:
        at = i - 1 + shift + d - band
        if 0 <= at < len(words) and words[at] == template[i - 1] and score[i][d] == score[i - 1][d] + 1:
            i -= 1
            out.append((i, at))
        elif score[i][d] == score[i - 1][d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return out[::-1]


def anchored(pairs: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    """The pairs of template places ``first`` to ``last`` and those that go on from them word by word."""
    low = next((n for n, (i, _) in enumerate(pairs) if i >= first), len(pairs))
    high = next((n for n in range(len(pairs) - 1, -1, -1) if pairs[n][0] <= last), -1)
    if low > high:
        return []
    step = lambda n: (pairs[n][0] + 1, pairs[n][1] + 1) == pairs[n + 1]
    while low > 0 and step(low - 1):
        low -= 1
    while high + 1 < len(pairs) and step(high):
        high += 1
    return pairs[low : high + 1]


def chains(stretches: list[list[tuple[int, int]]], least: float) -> list[tuple[int, int, int]]:
    """(matched words, first, last) of stretches joined in the order of the template and of the text.

    The join with most words comes first, of equals the shortest; others are made of the stretches outside it.
    """
    left, out = sorted((s for s in stretches if s), key=lambda s: s[0][1]), []
    while len({i for s in left for i, _ in s}) >= least:
        ends: list[tuple[int, int, int, int]] = []  # words, -span, last template place, first word, of the best join that ends here
        for n, s in enumerate(left):
            best = (len(s), s[0][1] - s[-1][1], s[-1][0], s[0][1])
            for (words, _, place, start), before in zip(ends, left[:n], strict=True):
                more = len(s) - max(bisect_right(s, place, key=lambda p: p[0]), bisect_right(s, before[-1][1], key=lambda p: p[1]))
                if more > 0:
                    best = max(best, (words + more, start - s[-1][1], s[-1][0], start))
            ends.append(best)
        n = max(range(len(ends)), key=lambda n: ends[n][:2])
        words, _, _, start = ends[n]
        if words < least:
            break
        last = left[n][-1][1]
        out.append((words, start, last))
        left = [s for s in left if s[-1][1] < start or s[0][1] > last]
    return out


class Scanner:
    def __init__(self) -> None:
        self.templates = [(name, n, [w.lower() for w in WORD.findall(text)]) for name, texts in TEMPLATES.items() for n, text in enumerate(texts)]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, _, words) in enumerate(self.templates):
            hashes = grams(words)
            for at in winnow(hashes):
                self.index.setdefault(int(hashes[at]), []).append((t, at))
        self.keys = np.sort(np.fromiter(self.index, np.uint64, len(self.index)))

    def candidates(self, words: list[str]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(template, diagonal, its hits as (diagonal, place in the template)) once for each stretch of near diagonals."""
        hashes = grams(words)
        if not len(hashes):
            return []
        near = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hits = sorted((t, int(at) - place, place) for at in np.nonzero(self.keys[near] == hashes)[0] for t, place in self.index[int(hashes[at])])
        out: list[tuple[int, int, list[tuple[int, int]]]] = []
        for t, diagonal, place in hits:
            if not out or out[-1][0] != t or diagonal - out[-1][1] > BAND:
                out.append((t, diagonal, []))
            out[-1][2].append((diagonal, place))
        return out

    def scan(self, text: str) -> list[tuple[str, int, float, int, int, int]]:
        """(license, template, coverage, matched words, start, end) of a whole text; code points.

        Of overlapping finds the one with most matched words stays.
        """
        words = WORD.findall(text.lower())
        found = []
        parts: dict[int, list[list[tuple[int, int]]]] = {}
        for t, diagonal, hits in self.candidates(words):
            name, n, template = self.templates[t]
            size = len(template)
            if size <= SHORT:
                for at in sorted({d for d, _ in hits}):
                    if at >= 0 and words[at : at + size] == template:
                        found.append((size, 1.0, name, n, at, at + size - 1))
                continue
            low = max(0, diagonal - BAND)
            pairs = [(i, low + at) for i, at in matches(template, words[low : diagonal + size + BAND + 1], diagonal - low)]
            if len(pairs) >= LEAST_COVERAGE * size:
                found.append((len(pairs), len(pairs) / size, name, n, pairs[0][1], pairs[-1][1]))
            places = [p for _, p in hits]
            parts.setdefault(t, []).append(anchored(pairs, min(places), max(places) + GRAM - 1))
        for t, stretches in parts.items():
            name, n, template = self.templates[t]
            if len(stretches) > 1:
                found += [(matched, matched / len(template), name, n, first, last) for matched, first, last in chains(stretches, LEAST_COVERAGE * len(template))]
        if not found:
            return []
        places = [m.span() for m in WORD.finditer(text.lower())]
        same = len(text.lower()) == len(text)
        out, taken = [], []
        for matched, coverage, name, n, first, last in sorted(found, key=lambda f: (-f[0], -f[1], f[2:])):
            if any(first <= b and a <= last for a, b in taken):
                continue
            taken.append((first, last))
            start, end = places[first][0], places[last][1]
            out.append((name, n, coverage, matched, start if same else _back(text, start), end if same else _back(text, end)))
        return sorted(out, key=lambda f: (f[4], f[0]))


def _back(text: str, at: int) -> int:
    """The place in ``text`` of a place in its lower-cased form, where that is longer."""
    seen = 0
    for i, c in enumerate(text):
        if seen >= at:
            return i
        seen += len(c.lower())
    return len(text)


def scanner() -> Scanner:
    return tool("licenses", Scanner)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each licence found in a whole text of (doc_id, text): doc_id, license, template,
    coverage, matched_words, span_start, span_end (code points, end exclusive).

    Null and empty texts have none, a null doc_id is reported like any other, repeated rows repeat
    their finds, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in slices(batches):
            rows = [(doc, *f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for f in scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, template int, coverage double, matched_words long, span_start long, span_end long")
