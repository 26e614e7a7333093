"""License scans: winnowed fingerprints of templates, then banded alignment.

Templates are read as words; the hashes of their word k-grams are winnowed (the least of every window) into an
inverted index of (template, position). A document's k-grams look themselves up; hits vote for a template and
a diagonal, and each diagonal with a vote is aligned with the template in a band around it, among the words that no
match has yet, until every vote lies in a match or its alignment fails. A match reports the share of the
template's words that stand in it in order, and its span in code points. Templates that differ from other licenses
in a name, clause or version alone have key phrases (:data:`KEYS`): a match must hold each, word for word.

The index is bounded by the list of templates and goes to every task; documents are scanned whole, in one
pass without a shuffle. With ``GRAM`` = 3 and ``WINDOW`` = 2 every run of 4 template words is found.

Defined cases: null and empty texts match nothing (0 matches); repeated rows are scanned one by one; ties
go to the first template in the list; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, sized, table

#: Words of a k-gram, k-grams of a winnowing window, half the width of a band, and the least coverage.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 16, 0.8

# License notices, headers and whole short licenses, without the numbers of list items.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": f"{BSD} {BSD_DISCLAIMER}",
    "BSD-3-Clause": (
        f"{BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        f"this software without specific prior written permission. {BSD_DISCLAIMER}"
    ),
}
#: Phrases by which a notice is told from those of other licenses and versions.
KEYS = {
    "MIT-notice": ("under the MIT License",),
    "Apache-2.0-notice": ("under the Apache License, Version 2.0",),
    "GPL-3.0-notice": ("under the GNU General Public License, version 3",),
    "CC-BY-NC-4.0-notice": ("under CC BY-NC 4.0",),
    "CC-BY-4.0-notice": ("under a Creative Commons Attribution 4.0 International",),
    "CC-BY-SA-4.0-notice": ("under a Creative Commons Attribution-ShareAlike 4.0 International",),
    "MPL-2.0-notice": ("Mozilla Public License, v. 2.0",),
    "Apache-2.0-header": ("under the Apache License, Version 2.0",),
    "GPL-3.0-header": ("GNU General Public License as published by", "version 3 of the License"),
    "MIT": ("shall be included in all copies or substantial portions",),
    "ISC": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "BSD-3-Clause": ("Neither the name of",),
}

WORD = re.compile(r"[a-z0-9]+")
SPLIT = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    """The words of :data:`WORD` in lower-cased text (ASCII), by one table look-up a byte."""
    return text.encode("utf-8", "surrogatepass").translate(SPLIT).split()


def winnow(grams: list, window: int) -> set[int]:
    """Positions of the least gram of each window, the last one of equals."""
    if not grams:
        return set()
    keys = [hash_of(g) for g in grams]
    return {min(range(i, min(i + window, len(keys))), key=lambda j: (keys[j], -j)) for i in range(max(1, len(keys) - window + 1))}


def hash_of(gram: tuple) -> int:
    h = 0xCBF29CE484222325
    for byte in b" ".join(gram):
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Index:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, keys: dict[str, tuple[str, ...]] | None = None) -> None:
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.keys = [[words_of(k) for k in (keys or {}).get(n, ())] for n in self.names]
        self.gram = gram
        self.at: dict[tuple, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            grams = list(zip(*(w[i:] for i in range(gram)), strict=False))
            for p in sorted(winnow(grams, window)):
                self.at.setdefault(grams[p], []).append((k, p))
        self.firsts = {g[0] for g in self.at}

    def candidates(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Document positions at which each template would start, by votes of its fingerprints, and the votes' own."""
        out: dict[int, list[tuple[int, int]]] = {}
        firsts = self.firsts
        for i, w in enumerate(words):
            if w in firsts:
                for k, p in self.at.get(tuple(words[i : i + self.gram]), ()):
                    out.setdefault(k, []).append((i - p, i))
        return out


def align(template: list[bytes], words: list[bytes], at: int, band: int = BAND, lowest: int = 0, end: int | None = None) -> tuple[int, int, int]:
    """The most template words that match document words from ``lowest`` up to ``end`` in order within ``band`` of
    the diagonal from ``at``: their number, and the first and the last document word."""
    end = len(words) if end is None else end
    none = (0, 0, 0)  # matches, minus the span's length, its end
    best: dict[int, tuple[int, int, int]] = {}  # document position -> (matches, first, last)
    for i, w in enumerate(template):
        low = max(lowest, at + i - band)
        now: dict[int, tuple[int, int, int]] = {}
        left = (0, -1, -1)
        for j in range(low, min(end, at + i + band + 1)):
            up, diagonal = best.get(j, (0, -1, -1)), best.get(j - 1, (0, -1, -1))
            options = [up, left]
            if words[j] == w:
                n, first, _ = diagonal
                options.append((n + 1, first if n else j, j))
            left = now[j] = max(options, key=lambda x: (x[0], x[1] - x[2], x[1]))
        best = now
    n, first, last = max(best.values(), key=lambda x: (x[0], x[1] - x[2], -x[1]), default=none)
    return n, first, last


def holds(words: list[bytes], first: int, last: int, keys: list[list[bytes]]) -> bool:
    """Whether each key phrase stands among the words from ``first`` to ``last``."""
    return all(any(words[i : i + len(k)] == k for i in range(first, last + 2 - len(k))) for k in keys)


def gap(spans: list[tuple[int, int]], i: int, n: int) -> tuple[int, int] | None:
    """The words around ``i``, of ``n``, that lie in none of the ordered ``spans``; None if it lies in one."""
    k = bisect_right(spans, (i, n))
    if k and spans[k - 1][1] >= i:
        return None
    return (spans[k - 1][1] + 1 if k else 0), (spans[k][0] if k < len(spans) else n)


def aligned(template: list[bytes], words: list[bytes], votes: list[tuple[int, int]], taken: list[tuple[int, int]], failed: list[tuple[int, int, int]], least: float, keys: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """Matches of a template among the words outside ``taken``, until each vote lies in one or has ``failed``."""
    spans, out = list(taken), []
    for at, i in votes:
        while (free := gap(spans, i, len(words))) is not None:
            low, end = free
            # The same diagonal, give or take the band, has failed among these words.
            if any(abs(at - a) <= BAND // 2 and a_low <= low and end <= a_end for a, a_low, a_end in reversed(failed)):
                break
            n, first, last = align(template, words, at, BAND, low, end)
            if not n or n < least * len(template) or not holds(words, first, last, keys):
                failed.append((at, low, end))
                break
            insort(spans, (first, last))
            out.append((n, first, last))
    return out


def scan(index: Index, text: str, least: float = COVERAGE) -> list[dict]:
    """Matches of at least ``least`` coverage, in order; of overlapping ones the longest stays, and the others are
    looked for again among the words that are left."""
    words = words_of(text)
    votes = {k: sorted(v) for k, v in index.candidates(words).items()}
    failed: dict[int, list[tuple[int, int, int]]] = {k: [] for k in votes}
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    while True:
        found = sorted((-n, k, first, last) for k, v in votes.items() for n, first, last in aligned(index.words[k], words, v, taken, failed[k], least, index.keys[k]))
        if not found:
            break
        for n, k, first, last in found:
            j = bisect_right(taken, (first, len(words)))
            if (not j or taken[j - 1][1] < first) and (j == len(taken) or last < taken[j][0]):
                kept.append((n, k, first, last))
                taken.insert(j, (first, last))
    if not kept:
        return []
    spots = [m.span() for m in WORD.finditer(ascii_lower(text))]
    return [
        {"license": index.names[k], "coverage": -n / len(index.words[k]), "start": spots[first][0], "end": spots[last][1]}
        for n, k, first, last in sorted(kept, key=lambda x: x[2])
    ]


LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(LOWER)


MATCHES = "doc_id long, n_matches long, licenses string, spans string, coverage double, matches array<struct<license:string,coverage:double,start:int,end:int>>"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The matches of every row. ``keys``: key phrases of one's own templates."""
    chosen = TEMPLATES if templates is None else templates
    phrases = KEYS if templates is None else keys

    def make():
        index = Index(chosen, keys=phrases)

        def each(doc_id, text):
            found = scan(index, text or "", least)
            spans = ",".join(f"{m['license']}:{m['start']}:{m['end']}" for m in found)
            yield doc_id, len(found), ",".join(sorted({m["license"] for m in found})), spans, max((m["coverage"] for m in found), default=0.0), found

        return each

    return sized(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, MATCHES), docs.count())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).drop("matches")
