"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Templates and texts are words of letters and digits, case ignored. Word 3-grams
of the templates are winnowed (the least hash of every three neighbours; of
templates up to SHORT words all 2-grams count, as one edit may spoil every
longer one), and an inverted index leads from a fingerprint to its templates and
places. A text's n-grams probe the index; hits on near diagonals form a candidate, and a banded
alignment of the whole template against the text around it reports which share
of the template's words match, in order, and the span they cover.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .rolling import U, Words, in_portions, winnowed

GRAM, WINNOW, SHORT = 3, 3, 12

#: (license, form, text): one-line statements and the notices that the licenses ask for.
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "statement", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "statement", "Released under the MIT License"),
    (
        "MIT",
        "notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "statement", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "statement", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "statement", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "statement", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "BSD-3-Clause",
        "notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "disclaimer",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-2-Clause",
        "notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "MIT",
        "disclaimer",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "notice",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "Unlicense",
        "license",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of "
        "our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law.",
    ),
    (
        "Zlib",
        "license",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution.",
    ),
    (
        "BSL-1.0",
        "notice",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "CC0-1.0",
        "notice",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to "
        "the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public "
        "Domain Dedication along with this software.",
    ),
    (
        "EPL-2.0",
        "notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
        "at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "GPL-2.0",
        "notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
]

_ASCII = re.compile(r"[A-Za-z0-9]")
_LOWER = np.array([ord(c.lower()) if _ASCII.match(c) else 32 for c in map(chr, range(128))], np.uint32)


def folded(points: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other ASCII but letters and digits as spaces; lengths stay."""
    return np.where(points < 128, _LOWER[np.minimum(points, 127)], points)


class Index:
    """The templates' words, and the inverted index of their fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.names = [(a, b) for a, b, _ in templates]
        self.words: list[np.ndarray] = []
        #: by n-gram length, from a fingerprint to (template, place)
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM - 1: defaultdict(list), GRAM: defaultdict(list)}
        self.prints: list[int] = []
        self.gram: list[int] = []
        for i, (_, _, text) in enumerate(templates):
            w = Words([text], folded)
            gram, width = (GRAM - 1, 1) if len(w.hash) <= SHORT else (GRAM, WINNOW)
            grams, valid = w.windows(gram)
            ok = np.ones(max(0, len(grams) - width + 1), bool)
            chosen, _ = winnowed(grams, valid, ok, width) if len(grams) >= width else (valid, None)
            for p in np.flatnonzero(chosen):
                self.places[gram][int(grams[p])].append((i, int(p)))
            self.words.append(w.hash)
            self.prints.append(int(chosen.sum()))
            self.gram.append(gram)
        self.keys = {g: np.array(sorted(p), U) for g, p in self.places.items()}


def aligned(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and last+1 matched place of text, of the best banded alignment.

    The template's word i may match text words offset + i - band to offset + i +
    band; matches keep their order, and as many as possible count. Ties prefer
    the alignment that begins later, then the one that ends sooner: the shorter span.
    """
    width = 2 * band + 1
    best = [(0, 0, 0)] * (width + 1)  # (matches, first place negated as 'later is better', -last) by diagonal
    for i, w in enumerate(template):
        row = [(0, 0, 0)] * (width + 1)
        left = (0, 0, 0)
        for d in range(width):
            j = offset + i + d - band
            cell = max(best[d + 1] if d + 1 < width else (0, 0, 0), left)  # skip a template word, or a text word
            if 0 <= j < len(text) and text[j] == w:
                n, first, _ = best[d]
                cell = max(cell, (n + 1, first if n else j + 1, -(j + 1)))
            row[d] = left = cell
        best = row
    n, first, last = max(best)
    return n, first - 1, -last


def _on(spans: list[tuple[int, int, int]], first: int, last: int) -> Iterator[int]:
    """The matched words of those ordered, separate spans that overlap first:last."""
    at = bisect_left(spans, (last,)) - 1
    while at >= 0 and spans[at][1] > first:
        yield spans[at][2]
        at -= 1


class Scanner:
    def __init__(self, index: Index, least: float, band: int, gap: int = 0):
        self.index, self.least, self.band, self.gap = index, least, band, gap

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text number, template, coverage, matched words, start, end in characters), non-overlapping for each template."""
        index = self.index
        w = Words(texts, folded)
        hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for gram, places in index.places.items():
            grams, valid = w.windows(gram)
            at = np.flatnonzero(valid & np.isin(grams, index.keys[gram]))
            for p, h in zip(at.tolist(), grams[at].tolist(), strict=True):
                for t, place in places[h]:
                    hits[int(w.doc[p]), t].append((p - place, p))
        copies: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)
        for (doc, t), found in sorted(hits.items()):
            begin, end = lo, hi = w.doc_from[doc], w.doc_from[doc + 1]
            need = max(1, index.prints[t] // 4)
            candidates = []
            # the hits of one copy lie on diagonals within the band of each other
            todo = [(lo, hi, group) for group in self._groups(sorted(found))]
            while todo:
                lo, hi, group = todo.pop()
                if len(group) < need:
                    continue
                diagonal = group[len(group) // 2][0]
                n, first, last = aligned(index.words[t], w.hash[lo:hi], diagonal - lo, self.band)
                first, last = first + lo, last + lo
                if n >= self.least * len(index.words[t]) and n:
                    # short copies side by side share a group: what lies beside this one is aligned by itself
                    candidates.append((-n, first, last))
                    todo.append((lo, first, [h for h in group if h[1] + index.gram[t] <= first]))
                    todo.append((last, hi, [h for h in group if h[1] >= last]))
                else:
                    todo.append((lo, hi, [h for h in group if h[0] < diagonal]))
                    todo.append((lo, hi, [h for h in group if h[0] > diagonal]))
            left = found
            for _, first, last in candidates:
                left = [h for h in left if h[1] + index.gram[t] <= first or h[1] >= last]
            candidates += self._chained(t, left, w.hash, begin, end)
            taken: list[tuple[int, int, int]] = []  # spans apart from each other, in order
            for n, first, last in sorted(set(candidates)):
                at = bisect_left(taken, (last,)) - 1
                if at < 0 or taken[at][1] <= first:
                    insort(taken, (first, last, -n))
            copies[doc].append((t, taken))
        for doc, found in copies.items():
            begin = w.first[doc]
            for t, taken in found:
                for first, last, n in taken:
                    share = n / len(index.words[t])
                    # of sister templates on one passage the one that it matches better stands
                    if not any(m >= n and m / len(index.words[o]) > share for o, others in found if o != t for m in _on(others, first, last)):
                        yield doc, t, share, n, int(w.starts[first] - begin), int(w.ends[last - 1] - begin)

    def _chained(self, t: int, found: list[tuple[int, int]], hashes: np.ndarray, begin: int, end: int) -> list[tuple[int, int, int]]:
        """Copies of a template that are parted by inserted words.

        The longest chains of hits in the order of text and template, which a diagonal may
        leave by `gap` words at a time, are cut where they leave it, and each part is aligned
        on its own diagonal.
        """
        words, gram = self.index.words[t], self.index.gram[t]
        need = max(2, self.index.prints[t] // 4)
        hits = sorted((p, p - d) for d, p in found) if len(found) >= need else []  # (place in the text, in the template)
        best, back = [1] * len(hits), [-1] * len(hits)
        for i, (p, place) in enumerate(hits):
            for j in range(i - 1, -1, -1):
                q, before = hits[j]
                if p - q > len(words) + self.gap:
                    break
                if q < p and before < place and (p - q) - (place - before) <= self.gap and best[j] + 1 > best[i]:
                    best[i], back[i] = best[j] + 1, j
        out: list[tuple[int, int, int]] = []
        used: set[int] = set()
        for i in sorted(range(len(hits)), key=lambda i: -best[i]):
            if best[i] < need:
                break
            chain, at = [], i
            while at >= 0 and at not in used:
                chain.append(at)
                at = back[at]
            if at >= 0:
                continue
            used.update(chain)
            parts: list[list[tuple[int, int]]] = []
            for p, place in (hits[c] for c in reversed(chain)):
                if not parts or abs((p - place) - (parts[-1][-1][0] - parts[-1][-1][1])) > self.band:
                    parts.append([])
                parts[-1].append((p, place))
            if len(parts) < 2:
                continue
            cuts = [0, *[(a[-1][1] + gram + b[0][1]) // 2 for a, b in zip(parts, parts[1:], strict=False)], len(words)]
            total, spans, start = 0, [], begin
            for k, part in enumerate(parts):
                p, place = part[len(part) // 2]
                n, first, last = aligned(words[cuts[k] : cuts[k + 1]], hashes[start:end], p - place - start + cuts[k], self.band)
                if n:
                    total += n
                    spans.append((first + start, last + start))
                    start += last
            if total >= self.least * len(words):
                out.append((-total, spans[0][0], spans[-1][1]))
        return out

    def _groups(self, found: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        i = 0
        for j in range(1, len(found) + 1):
            if j == len(found) or found[j][0] - found[j - 1][0] > self.band or found[j][0] - found[i][0] > 2 * self.band:
                yield found[i:j]
                i = j


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, coverage: float = 0.8, band: int = 8, gap: int = 64) -> DataFrame:
    """doc_id, license, form, coverage, matched_words, start, end: one row for each template copy found.

    start and end count code points of the text. A copy may have `band` more or
    fewer words than the template up to any of its places, and up to `gap` words inserted at one
    place, several times; its span goes on over these. A document may match several
    templates (of overlapping ones the better matched stands), and one template at several places; without a match it has no
    row. Null and empty texts match nothing; repeated rows repeat their matches;
    null ids are kept. Very long texts are scanned whole, in portions of one
    text. An empty table gives an empty result; further columns are ignored. The
    templates are a short list that every task holds.
    """
    scanner = Scanner(Index(templates or TEMPLATES), coverage, band, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, found = batch.column("text").to_pylist(), []
            for lo, hi in in_portions(texts):
                found += [(lo + d, *scanner.index.names[t], round(c, 6), n, s, e) for d, t, c, n, s, e in scanner.scan(texts[lo:hi])]
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            arrays = [ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "license", "form", "coverage", "matched_words", "start", "end"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, form string, coverage double, matched_words long, start long, end long")
