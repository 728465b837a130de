"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates and texts are lower-cased words of letters and digits, cut into shingles of five words.  A
template of s shingles is looked for in windows of k blocks of g shingles that begin at
every block, with g a power of two and k such that any s shingles in a row lie whole in a window:
g is 1 up to eight shingles, where windows are as long as the template, and else such that windows
exceed it by at most a half.  So a window that holds 0.8 of the template resembles it by a
similarity (Jaccard) that is known beforehand, and the number of bands of two rows is
set from it so that such a window meets its template in no band with probability below MISS.

Every window's band keys are looked up among the templates' keys; what meets in a band
is compared exactly.  Minima of blocks are made once per hash function and joined to windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, text_buffers, windows

SHINGLE, CONTAINMENT, ROWS = 5, 0.8, 2
#: Probability that a window which holds a template isn't retrieved, at most.
MISS = 1e-6
BATCH_BYTES = 1 << 20
#: Bytes of all templates together, at most: every task holds their index.
MOST_TEMPLATE_BYTES = 64 << 20
_U = np.uint64
_FULL = _U(2**64 - 1)

#: Notices and licenses that the scan looks for: public texts, as commonly printed.
TEMPLATES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties '
        "to whom the Software is furnished to do so, all subject to the following:"
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution."
    ),
}

_PLAIN = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_low:_high] = np.arange(_low, _high)
_PLAIN[65:91] = np.arange(97, 123)


@dataclass
class Template:
    name: str
    shingles: np.ndarray = field(repr=False)  # distinct, sorted
    wider: frozenset[str] = frozenset()  # templates that hold this one: where they stand it isn't reported


def layout(shingles: int) -> tuple[int, int]:
    """(g, k): windows are k blocks of g shingles."""
    g = 1
    while (shingles - 1) / g > 8:
        g *= 2
    return g, (shingles if g == 1 else math.ceil((shingles - 1) / g) + 1)


def least_similarity(shingles: int, distinct: int, containment: float = CONTAINMENT) -> float:
    """Of a window that holds enough of a template's distinct shingles: its least Jaccard similarity to the template."""
    g, k = layout(shingles)
    shared = math.ceil(containment * distinct - 1e-9)
    return shared / (distinct + g * k - shared)


def bands_for(similarity: float, miss: float = MISS, rows: int = ROWS) -> int:
    """Bands of so many rows in none of which two sets of that similarity agree with probability below ``miss``."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def _permutation(values: np.ndarray, k: int) -> np.ndarray:
    """Hash function number k of shingle hashes, which are mixed already: an odd factor and a mask."""
    factor = mix(np.array([2 * k + 1], _U))[0] | _U(1)
    return (values * factor) ^ mix(np.array([2 * k + 2], _U))[0]


def _band_key(minima: list[np.ndarray]) -> np.ndarray:
    """One number of a band's minima, which are as good as random; each band has its own table of keys."""
    key = minima[0]
    for m in minima[1:]:
        key = key * _U(0x9E3779B97F4A7C15) + m
    return key


class TemplateIndex:
    """Templates by the windows they need, under their band keys; as small as the texts given."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError("the templates exceed MOST_TEMPLATE_BYTES")
        self.containment = containment
        groups: dict[tuple[int, int], list[tuple[Template, int]]] = {}
        sets: dict[str, tuple[np.ndarray, int]] = {}
        for name, text in sorted(templates.items()):
            data, offsets = text_buffers(pa.array([text]))
            words = Words(_PLAIN[data], offsets)
            hashes = windows(words.hash, words.doc, SHINGLE)[0]
            if not len(hashes):
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            sets[name] = np.unique(hashes), len(hashes)
        for name, (own, count) in sets.items():
            wider = {n for n, (x, _) in sets.items() if len(x) > len(own) and len(np.intersect1d(own, x, assume_unique=True)) >= containment * len(own)}
            groups.setdefault(layout(count), []).append((Template(name, own, frozenset(wider)), bands_for(least_similarity(count, len(own), containment))))
        #: (g, k): templates, and per band its sorted keys, the template of each, and which leading 16 bits keys have.
        self.groups: dict[tuple[int, int], tuple[list[Template], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}
        for shape, own in groups.items():
            templates_ = [t for t, _ in own]
            tables = []
            for band in range(max(b for _, b in own)):
                minima = [np.array([_permutation(t.shingles, ROWS * band + r).min() for t in templates_]) for r in range(ROWS)]
                keys = _band_key(minima)
                order = np.argsort(keys, kind="stable")
                known = np.zeros(1 << 16, bool)
                known[keys >> _U(48)] = True
                tables.append((keys[order], order, known))
            self.groups[shape] = templates_, tables
        self.functions = ROWS * max((len(tables) for _, tables in self.groups.values()), default=0)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(text, template, first word, end word, containment) of every occurrence, in order."""
        words = Words(_PLAIN[data], offsets)
        hashes, at = windows(words.hash, words.doc, SHINGLE)
        if not len(hashes):
            return
        doc = words.doc[at]
        first = np.searchsorted(doc, np.arange(len(offsets)))  # first shingle of each text
        shapes = {}
        for g, k in self.groups:
            blocks = -(-np.diff(first) // g)
            start = np.repeat(first[:-1] - g * (np.cumsum(blocks) - blocks), blocks) + g * np.arange(int(blocks.sum()))
            shapes[g, k] = start, np.minimum(start + g * k, np.repeat(first[1:], blocks)), _doublings(np.repeat(np.cumsum(blocks), blocks), k)
        met: dict[tuple[int, int], list[np.ndarray]] = {shape: [] for shape in self.groups}
        minima: dict[tuple[int, int], list[np.ndarray]] = {shape: [] for shape in self.groups}
        for n in range(self.functions):
            values = _permutation(hashes, n)
            blocks_of: dict[int, np.ndarray] = {}
            for (g, k), (start, _, plan) in shapes.items():
                tables = self.groups[g, k][1]
                if n >= ROWS * len(tables):
                    continue
                if g not in blocks_of:
                    blocks_of[g] = values if g == 1 else np.minimum.reduceat(values, start)
                minima[g, k].append(_window_minima(blocks_of[g], plan))
                if len(minima[g, k]) == ROWS:
                    band = n // ROWS
                    keys, template, known = tables[band]
                    own = _band_key(minima[g, k])
                    minima[g, k] = []
                    may = np.flatnonzero(known[own >> _U(48)])
                    low, high = np.searchsorted(keys, own[may], "left"), np.searchsorted(keys, own[may], "right")
                    for t in range(int((high - low).max()) if len(may) else 0):
                        some = np.flatnonzero(high - low > t)
                        met[g, k].append(may[some] * len(keys) + template[low[some] + t])
        found: list[tuple[int, int, int, float, Template]] = []
        for shape, pairs in met.items():
            templates, (start, end, _) = self.groups[shape][0], shapes[shape]
            for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                w, t = divmod(pair, len(templates))
                found += self._verified(hashes, at, words.first, int(doc[start[w]]), int(start[w]), int(end[w]), templates[t])
        yield from _occurrences(found)

    def _verified(self, hashes, at, begun, doc: int, start: int, end: int, template: Template):
        """The window's part from the first to the last shingle of the template, if it holds enough of them."""
        place = np.minimum(np.searchsorted(template.shingles, hashes[start:end]), len(template.shingles) - 1)
        inside = np.flatnonzero(template.shingles[place] == hashes[start:end])
        share = len(np.unique(place[inside])) / len(template.shingles)
        if share >= self.containment:
            base = int(begun[doc])
            yield doc, int(at[start + inside[0]]) - base, int(at[start + inside[-1]]) - base + SHINGLE, share, template


def _doublings(ends: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """Steps that join the minima of k blocks in a row, and the blocks whose text ends within each (before block ``ends``)."""
    index, size, plan = np.arange(len(ends)), 1, []
    while size < k:
        step = min(size, k - size)
        plan.append((step, np.flatnonzero(index + step >= ends)))
        size += step
    return plan


def _window_minima(blocks: np.ndarray, plan: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Least of each block and those after it in its window."""
    out = blocks
    for step, beyond in plan:
        ahead = np.empty_like(out)
        ahead[:-step] = out[step:]
        ahead[beyond] = _FULL
        out = np.minimum(out, ahead)
    return out


def _occurrences(found):
    """Of overlapping windows of one text and template the best (then first) stands; what a wider template covers is left out."""
    best: dict[tuple[int, str], list[tuple[int, int, float, Template]]] = {}
    for doc, start, end, share, template in sorted(found, key=lambda x: (-x[3], x[2] - x[1], x[1])):
        own = best.setdefault((doc, template.name), [])
        if all(end <= a or start >= b for a, b, _, _ in own):
            own.append((start, end, share, template))
    for (doc, name), own in sorted(best.items()):
        for start, end, share, template in sorted(own, key=lambda x: x[:2]):
            if not any(a < end and start < b for n in template.wider for a, b, _, _ in best.get((doc, n), ())):
                yield doc, name, start, end, share


def templates_of(table: DataFrame, name_column: str = "license", text_column: str = "text") -> dict[str, str]:
    """Templates from a table, which has to be small: its size is checked before it is gathered."""
    rows = table.where(F.col(name_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(name_column).cast("string"), F.col(text_column).cast("string"))
    size = rows.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError("the templates exceed MOST_TEMPLATE_BYTES")
    return dict(sorted((r[0], r[1]) for r in rows.collect()))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word, end_word): every occurrence of every template.

    Containment is the share of the template's distinct shingles found in a window, at least
    ``containment``; the words named are those from the first to the last of them.  Of windows of one template that overlap the
    best stands, of equal ones the shorter, then the first.  A template that another one holds isn't reported where that one
    stands.  ``templates`` are texts by name, or a small table (license, text); each has five words at least.  Texts
    without a template, null and empty ones give no row; a repeated row gives its rows again; null ids stay
    null.  A very long text is scanned whole, with some hundred bytes of memory a word.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    index = TemplateIndex(TEMPLATES if templates is None else templates, containment)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates, which are bounded
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))

    def run(batches):
        index = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids, found = batch.column(0).to_pylist(), []
            for i, j in slices(offsets, BATCH_BYTES):
                found += [(ids[i + d], name, share, a, b) for d, name, a, b, share in index.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=["id", "license", "containment", "first_word", "end_word"])

    return rows.mapInArrow(run, "id long, license string, containment double, first_word long, end_word long")
