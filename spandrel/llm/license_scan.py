"""Licence texts and notices in documents, by the Dice coefficient of word bigrams.

A text and the templates are normalised (lower case, letters and digits only).
A stretch of words and a template with m and n distinct bigrams, c of them
common, have the coefficient 2c / (m + n). For at least ``least`` a stretch
has between n * least / (2 - least) and n * (2 - least) / least bigrams, and at
least n * least / 2 of the template's: templates that a document has too few
bigrams for are pruned, and only stretches of a size within the bounds, which
begin and end at a bigram of the template, are compared. So a licence is found
wherever it stands in a document, and a whole-file licence as well.

Null and empty texts hold no licence. Repeated rows are reported each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spandrel.runtime import ship

LEAST = 0.8
CACHE_ENTRIES = 300_000
_WORDS = re.compile(r"[^\W_]+")

# The texts of common licences and of their usual notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
    "all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
    "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL_HEADER),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", _MPL_HEADER),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def normal_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def bigrams(words: list) -> set:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    """Templates as numbered words and bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.least, self.names = least, [n for n, _ in templates]
        self.vocabulary: dict[str, int] = {}
        lists = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normal_words(t)] for _, t in templates]
        self.base = len(self.vocabulary) + 1
        self.sets = [{a * self.base + b for a, b in bigrams(ws)} for ws in lists]
        self.of: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            for g in s:
                self.of.setdefault(g, []).append(t)
        self.codes = np.array(sorted(self.of), np.int64)
        self.chunks: dict[str, list[int]] = {}

    def _numbers(self, text: str) -> np.ndarray:
        """The words of a text as numbers; all that no template has are one."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        known, out = self.chunks, []
        for chunk in text.split():
            got = known.get(chunk)
            if got is None:
                got = [self.vocabulary.get(w, self.base - 1) for w in normal_words(chunk)]
                if len(chunk) <= 48:
                    known[chunk] = got
            out += got
        return np.array(out, np.int64)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, words) of the stretches found, the best of those that overlap."""
        if not text:
            return []
        ids = self._numbers(text)
        if len(ids) < 2:
            return []
        grams = ids[:-1] * self.base + ids[1:]
        at = np.searchsorted(self.codes, grams)
        hits = np.flatnonzero(self.codes[np.minimum(at, len(self.codes) - 1)] == grams)
        places: dict[int, list[int]] = {}
        for i in hits.tolist():
            for t in self.of[int(grams[i])]:
                places.setdefault(t, []).append(i)
        found = []
        for t, where in places.items():
            n = len(self.sets[t])
            if len(where) < n * self.least / 2 or len(set(grams[where].tolist())) < n * self.least / 2:  # too few of its bigrams in the whole document
                continue
            found += self._best(t, where, ids)
        found.sort(key=lambda x: (-x[1], -x[3], x[2]))
        kept: list[tuple[str, float, int, int]] = []
        for x in found:
            if not any(x[2] < k[2] + k[3] and k[2] < x[2] + x[3] for k in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[2])

    def _best(self, t: int, where: list[int], ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        """The best stretch of each run of hits that the size bounds keep together."""
        template, n = self.sets[t], len(self.sets[t])
        most = n * (2 - self.least) / self.least
        out, first = [], 0
        while first < len(where):
            best = None
            common: set[int] = set()
            seen: set[int] = set()
            at = where[first]
            for last in range(first, len(where)):
                # Words since the last hit join the stretch.
                for i in range(at, where[last] + 1):
                    g = int(ids[i]) * self.base + int(ids[i + 1])
                    # Words outside the templates stand for any: each place is its own bigram.
                    seen.add(g if g in template else -i - 1)
                    if g in template:
                        common.add(g)
                at = where[last] + 1
                if len(seen) > most:
                    break
                d = 2 * len(common) / (len(seen) + n)
                if d >= self.least and (best is None or d > best[1]):
                    best = (self.names[t], d, where[first], where[last] - where[first] + 2, last)
            if best:
                out.append(best[:4])
                first = best[4] + 1
            else:
                first += 1
        return out


_scanners: dict = {}


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: key, license (the best match, or null), dice, n_matches, and all matches."""
    ship(docs.sparkSession)
    kinds = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (templates, least) not in _scanners:
            _scanners[templates, least] = Scanner(templates, least)
        scanner = _scanners[templates, least]
        for b in batches:
            found = [scanner.scan(t) for t in b.column(1).to_pylist()]
            best = [max(f, key=lambda x: (x[1], x[3], -x[2])) if f else (None, None) for f in found]
            matches = [[{"license": n, "dice": d, "first_word": s, "n_words": w} for n, d, s, w in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array(matches, kinds)], names=[key, "license", "dice", "n_matches", "matches"])

    out = f"`{key}` {docs.schema[key].dataType.simpleString()}, license string, dice double, n_matches int, matches array<struct<license:string,dice:double,first_word:bigint,n_words:bigint>>"
    return docs.select(key, docs[text_col].alias("__text")).mapInArrow(run, out)
