"""License scan by patience alignment.

Text and template are word sequences. Words that occur once in both are anchors; the longest increasing subsequence of these is kept, and the gaps between them are
aligned in the same way; a gap without such words is aligned by longest common subsequence. Coverage is the share of the template's words that are matched.

A text is aligned in windows that hold any find whole: a find of n template words spans at most n / dense words, windows are that and one template long and start every template length,
however often a copy is repeated. Matches far off at either end are left out: of an alignment the longest stretch that is dense enough counts. A template is tried on a text only if the text has at least the share `least` of the template's words (each as often
as the text might have it), which coverage needs. A find needs coverage >= least and matches that fill at least the share `dense` of the words from the first to the last.

Defined results: null and wordless texts have no finds; the best window counts, of equal ones the first; several templates may be found in one text; repeated rows give
repeated finds; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

#: Whole license texts, the notices that licenses ask for (-header) and one-line mentions (-line).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of positions; ties end early in a."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by the first, that increases in the second."""
    tails, at, back = [], [], [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        back[k] = at[i - 1] if i else -1
        if i == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        once: dict = {}
        for i in range(i0, i1):
            once[a[i]] = -1 if a[i] in once else i
        twice: dict = {}
        for j in range(j0, j1):
            twice[b[j]] = -1 if b[j] in twice else j
        anchors = _increasing(sorted((i, twice[w]) for w, i in once.items() if i >= 0 and twice.get(w, -1) >= 0))
        if not anchors:
            out += [(i0 + i, j0 + j) for i, j in _common(a[i0:i1], b[j0:j1])]
            continue
        out += anchors
        edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, dense: float):
        self.names, self.least, self.dense = sorted(templates), least, dense
        h, at = text.words(pa.array([templates[n] for n in self.names], pa.large_string()))
        self.words = [h[at[k] : at[k + 1]] for k in range(len(self.names))]
        self.vocabulary = np.unique(h)
        self.need = np.zeros((len(self.vocabulary), len(self.names)))
        for k, w in enumerate(self.words):
            at, n = np.unique(np.searchsorted(self.vocabulary, w), return_counts=True)
            self.need[at, k] = n
        self.sequences = [np.searchsorted(self.vocabulary, w).tolist() for w in self.words]

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, int, int, int]]:
        """(row, template, coverage, first word, last word, words matched) of each find."""
        out = []
        for a, t in text.chunks(texts):
            h, at = text.words(t)
            place = np.searchsorted(self.vocabulary, h)
            place[place == len(self.vocabulary)] = 0
            known = np.flatnonzero(self.vocabulary[place] == h) if len(h) else np.zeros(0, np.int64)
            doc = np.searchsorted(at, known, "right") - 1
            has = np.zeros((len(t), len(self.vocabulary)), bool)
            has[doc, place[known]] = True
            bound = has @ self.need / self.need.sum(0)  # a word that is there may be there often enough
            for d, k in np.argwhere(bound >= self.least - 1e-9):
                got = self.best(np.where(np.isin(known_words := place[at[d] : at[d + 1]], self.sequences[k]) & (self.vocabulary[known_words] == h[at[d] : at[d + 1]]), known_words, -1), int(k))
                if got:
                    out.append((a + int(d), self.names[k], *got))
        return out

    def best(self, words: np.ndarray, k: int) -> tuple[float, int, int, int] | None:
        """The best find of template k in a text given as places in the vocabulary, -1 for other words."""
        template, n = self.sequences[k], len(self.sequences[k])
        own = np.concatenate([[0], np.cumsum(words >= 0)])
        found = None
        for i in range(0, max(1, len(words)), n):
            j = min(i + n + int(n / self.dense) + 1, len(words))
            if own[j] - own[i] < self.least * n:
                continue
            inside = np.flatnonzero(words[i:j] >= 0)
            pairs = patience(words[i:j][inside].tolist(), template)
            stretch = self._dense(i + inside[[p[0] for p in pairs]] if pairs else inside[:0], n)
            if stretch and (found is None or stretch[2] > found[3]):
                found = (round(stretch[2] / n, 6), *stretch)
                if stretch[2] == n:
                    break
        return found

    def _dense(self, at: np.ndarray, n: int) -> tuple[int, int, int] | None:
        """(first word, last word, matches) of the longest stretch of matches that is dense and covers enough, the first of equal ones."""
        for m in range(len(at), int(np.ceil(self.least * n - 1e-9)) - 1, -1):
            ok = np.flatnonzero(m >= self.dense * (at[m - 1 :] - at[: len(at) - m + 1] + 1) - 1e-9) if m else []
            if len(ok):
                return int(at[ok[0]]), int(at[ok[0] + m - 1]), m
        return None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, dense: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, matched)."""
    scanner = Scanner(TEMPLATES if templates is None else templates, least, dense)

    def run(batches):
        for b in batches:
            got = scanner.scan(b.column(1))
            ids = b.column(0).take(pa.array([g[0] for g in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([g[k] for g in got], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()))]], ["doc_id", "license", "coverage", "first_word", "last_word", "matched"])

    store.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(text.tidied(run), "doc_id long, license string, coverage double, first_word long, last_word long, matched long")
