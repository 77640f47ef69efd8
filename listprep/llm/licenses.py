"""License scan by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, words of letters and digits, cut into
segments at ends of lines and sentences, no bigram across a cut. A passage that may be a
template's text is any stretch of bigrams that begins and ends with one of the template's, inside
segments and over foreign ones; each end is moved out to its segment's end where the coefficient
allows it. Its Dice coefficient with the
template, 2 |A and B| / (|A| + |B|) over sets of bigrams, has to reach ``DICE``; a passage whose
size alone rules that out is not compared: |A| must lie between d / (2 - d) and (2 - d) / d
times |B|. Where passages of several templates overlap, the best one stands (higher coefficient,
then more bigrams, then the template's place in the list).

The templates are a bounded list that goes to every task. Null and empty texts, and texts of no
known bigram, have no rows. Rows that repeat a ``doc_id``, or have none, are scanned each by
its own text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import arrow_map

DICE = 0.8
_FILTER_BITS = 20

# Names of licences, the forms of notices that name them, and public licence texts.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
FORMS = (
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the {}.",
)
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)
_BSD = TEXTS[-1][1]
_BSD_3 = (
    "\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public "
    "License as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later "
    "version.\n"
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."
)
TEXTS += (
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_3),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_DISCLAIMER),
    (
        "ISC",
        TEXTS[-2][1] + '\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-2.0", _GNU.format("program", ";", "", "2")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser ", "3")),
    ("LGPL-3.0", _GNU.format("program", ":", "Lesser ", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero ", "3")),
)
TEMPLATES = tuple((key, form.format(name)) for key, name in NAMES for form in FORMS) + TEXTS

FOUND = "doc_id long, license string, template int, dice double, n_bigrams int, start int, end int"


def _bigrams(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words by text, first words of the segments, hashes of bigrams inside segments, their first words."""
    found = words.words_of(texts, breaks=words.NO_LETTER)
    first = words.segments(found)
    h = found.hashes
    if len(h) < 2:
        return found, first, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    pair = words.mix(h[:-1] * np.uint64(words._BASE) + h[1:])
    inside = np.ones(len(pair), dtype=bool)
    inside[first[first > 0] - 1] = False
    at = np.flatnonzero(inside)
    return found, first, pair[at], at


class Matcher:
    """Templates as sets of bigrams, and which templates hold a bigram."""

    def __init__(self, templates: Sequence[tuple[str, str]], dice: float):
        self.names, self.dice = [name for name, _ in templates], dice
        self.sets = [set(_bigrams(pa.array([text]))[2].tolist()) for _, text in templates]
        holders: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            for pair in own:
                holders.setdefault(pair, []).append(k)
        self.holders = holders
        self.pairs = np.array(sorted(holders), dtype=np.uint64)
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.pairs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def known(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), dtype=bool)
        if len(self.pairs):
            place = np.flatnonzero(self.maybe[(pairs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            number = np.minimum(np.searchsorted(self.pairs, pairs[place]), len(self.pairs) - 1)
            out[place] = self.pairs[number] == pairs[place]
        return out

    def _stretches(self, flat: list[int], places: list[int], k: int) -> list[tuple[float, int, int]]:
        """Coefficient, first and last bigram of the best stretch from each of a template's bigrams in a text.

        An end that recurs inside a stretch adds nothing to its set, so that a stretch from a
        bigram ends before the next place of the same one.
        """
        own, m, d = self.sets[k], len(self.sets[k]), self.dice
        least, most = d / (2 - d) * m, m * (2 - d) / d
        # distinct foreign bigrams before each hit; None where they are too many for any stretch
        gaps: list[set[int] | None] = [set()]
        for a, b in zip(places, places[1:]):
            gap = set(flat[a + 1 : b])
            gaps.append(gap if len(gap) <= most else None)
        found = []
        for i, start in enumerate(places):
            shared, foreign, best = {flat[start]}, set(), (0.0, 0, 0)
            for j in range(i, len(places)):
                if j > i:
                    pair, gap = flat[places[j]], gaps[j]
                    if pair == flat[start] or gap is None:
                        break
                    foreign |= gap
                    if pair in shared:
                        continue
                    shared.add(pair)
                if len(shared) + len(foreign) > most:
                    break
                if len(shared) >= least:
                    dice = 2 * len(shared) / (len(shared) + len(foreign) + m)
                    best = max(best, (dice, start, places[j]), key=lambda p: p[0])
            if best[0] >= d and best[0] > 0:
                found.append(best)
        return found

    def passages(self, segments: list[list[int]]) -> list[tuple[int, float, int, int, int]]:
        """Template, coefficient, bigrams, first and last bigram of the best passages of a text,
        given the bigrams of each of its segments."""
        flat = [pair for own in segments for pair in own]
        begins, ends = [], []
        for own in segments:
            begins += [len(begins)] * len(own)
            ends += [len(ends) + len(own) - 1] * len(own)
        hits: dict[int, list[int]] = {}
        for number, pair in enumerate(flat):
            for k in self.holders.get(pair, ()):
                hits.setdefault(k, []).append(number)
        found = []
        for k, places in hits.items():
            template = self.sets[k]
            if len({flat[p] for p in places}) < self.dice / (2 - self.dice) * len(template):
                continue
            taken = np.zeros(len(flat), dtype=bool)
            # of one template, only stretches that overlap no better one go on
            for _, a, b in sorted(self._stretches(flat, places, k), key=lambda p: (-p[0], p[1])):
                if taken[a : b + 1].any():
                    continue
                taken[a : b + 1] = True
                for x, y in ((begins[a], ends[b]), (begins[a], b), (a, ends[b]), (a, b)):
                    own = set(flat[x : y + 1])
                    dice = 2 * len(own & template) / (len(own) + len(template))
                    if dice >= self.dice:
                        found.append((k, dice, len(own), x, y))
                        break
        found.sort(key=lambda p: (-p[1], -p[2], p[0], p[3]))
        best: list[tuple[int, float, int, int, int]] = []
        free = np.ones(len(flat), dtype=bool)
        for one in found:
            if free[one[3] : one[4] + 1].all():
                free[one[3] : one[4] + 1] = False
                best.append(one)
        return sorted(best, key=lambda p: p[3])


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row per passage: ``doc_id``, ``license``, ``template`` (its place in the list),
    ``dice``, ``n_bigrams``, ``start`` and ``end`` (characters, the end not included)."""
    matcher = Matcher(templates, dice)
    fewest = min((dice / (2 - dice) * len(own) for own in matcher.sets if own), default=0)

    def per_batch(batch):
        texts = batch.column("text")
        for i, j in words.slices(texts):
            found, first, pairs, at = _bigrams(texts.slice(i, j - i))
            # texts with so many known bigrams as the shortest template asks for
            segment = np.searchsorted(first, at, side="right") - 1
            owner = np.searchsorted(found.first, first, side="right") - 1
            known = np.bincount(owner[segment], matcher.known(pairs), minlength=j - i)
            begin = np.searchsorted(owner, np.arange(j - i + 1))
            bounds = np.searchsorted(segment, np.arange(len(first) + 1))
            rows = []
            for k in np.flatnonzero((known > 0) & (known >= fewest)).tolist():
                parts = [pairs[bounds[s] : bounds[s + 1]].tolist() for s in range(begin[k], begin[k + 1])]
                for template, value, n, a, b in matcher.passages(parts):
                    a, b = at[bounds[begin[k]] + a], at[bounds[begin[k]] + b] + 1
                    span = np.array([found.start[a], found.end[b]])
                    start, end = words.char_places(found.data, found.text_start, np.array([k, k]), span).tolist()
                    rows.append((k, matcher.names[template], template, value, n, start, end))
            if rows:
                row, *columns = zip(*rows)
                kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                ids = batch.column("doc_id").slice(i, j - i).take(pa.array(row))
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, FOUND, per_batch)
