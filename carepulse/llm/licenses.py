"""License scans: Dice coefficient over word bigrams against licence templates.

The units of a text are its lines, its paragraphs (between blank lines), the
whole text, and for each template the runs of words, across lines and
paragraphs, that begin and end with its bigrams.  For bigram sets A and B the coefficient 2|A & B| / (|A| + |B|) can
reach t only if |B| lies between |A| t/(2-t) and |A| (2-t)/t: templates outside
these bounds are never compared.  A match also holds more than the share t/(2-t)
of a template's bigrams, so it holds one of any words that touch the rest of
them: texts and units without such an anchor word are passed over."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, batch, map_batches, table

# The wording of common licence notices (name, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
     "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
     "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
     "OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution. "
     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
     "of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
)
_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
_ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# the whole wordings beside the notices
TEMPLATES += tuple((n, t + (_ISC_DISCLAIMER if n == "ISC" else _DISCLAIMER)) for n, t in TEMPLATES
                   if n in ("ISC", "BSD-2-Clause", "BSD-3-Clause"))
THRESHOLD = 0.8
_BLANK_LINES = re.compile(r"\n[ \t]*\n")
_NOT_WORD = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Normalised words: lower case, of letters and digits."""
    return _NOT_WORD.sub(" ", text.lower()).split()


def bigrams(w: list[str]) -> frozenset:
    """Bigrams of words; one word alone is its own bigram."""
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset((x, "") for x in w)


def anchors_of(grams: frozenset, threshold: float) -> set[str]:
    """The longest words of a template whose bigrams are too many to miss: a
    unit without any of them cannot reach the threshold."""
    spare, out, touched = len(grams) * (1 - threshold / (2 - threshold)), set(), 0
    for w in sorted({x for g in grams for x in g if x}, key=lambda x: (-len(x), x)):
        if touched > spare + 1e-9:
            break
        out.add(w)
        touched = sum(a in out or b in out for a, b in grams)
    return out


class Templates:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.sets = sorted(((len(g), name, g) for name, g in (
            (n, bigrams(words_of(t))) for n, t in templates) if g), key=lambda x: (x[0], x[1]))
        self.sizes = [s for s, _, _ in self.sets]
        self.threshold = threshold
        self.ratio = (2 - threshold) / threshold
        self.anchors = set().union(*(anchors_of(g, threshold) for _, _, g in self.sets))
        self.holders: dict = {}              # bigram: the templates that hold it
        for k, (_, _, g) in enumerate(self.sets):
            for x in g:
                self.holders.setdefault(x, []).append(k)

    def match(self, grams: frozenset) -> list[tuple[str, float]]:
        """(name, coefficient) of the best templates that reach the threshold."""
        return [x[:2] for x in self.matches(grams)]

    def matches(self, grams: frozenset) -> list[tuple[str, float, int]]:
        """``match`` with the number of shared bigrams."""
        n, out = len(grams), {}
        lo = bisect_left(self.sizes, n / self.ratio - 1e-9)
        hi = bisect_right(self.sizes, n * self.ratio + 1e-9)
        for size, name, g in self.sets[lo:hi]:
            shared = len(grams & g)
            dice = 2 * shared / (n + size)
            if dice >= self.threshold:
                out[name] = max((dice, shared), out.get(name, (0.0, 0)))
        best = max((d for d, _ in out.values()), default=0.0)
        return sorted((k, d, c) for k, (d, c) in out.items() if d == best)

    def windows(self, words: list[str]):
        """(first word, last word, name, coefficient, shared bigrams) of runs of
        words that reach the threshold: from each bigram of a template the best
        run, among those of a size that can match."""
        grams = list(zip(words, words[1:]))
        at: dict[int, list[int]] = {}
        for i, x in enumerate(grams):
            for k in self.holders.get(x, ()):
                at.setdefault(k, []).append(i)
        for k, hits in at.items():
            size, name, g = self.sets[k]
            need, most = size / self.ratio - 1e-9, size * self.ratio + 1e-9
            reach = int(2 * most) + 1        # twice the size: bigrams may repeat
            done = -1
            for n, i in enumerate(hits):
                if i <= done or bisect_right(hits, i + reach) - n < need:
                    continue
                seen, shared, best, end = set(), 0, (0.0, 0), i
                for j in range(i, min(i + reach, hits[-1]) + 1):
                    x = grams[j]
                    if x in seen:
                        if end == j - 1 and x in g:
                            end = j          # the run goes on with words it had before
                        continue
                    seen.add(x)
                    if len(seen) > most:
                        break
                    if x in g:
                        shared += 1
                        if (now := (2 * shared / (len(seen) + size), shared)) > best:
                            best, end = now, j
                if best[0] >= self.threshold:
                    yield i, end + 1, name, *best
                    if best[0] == 1.0:
                        done = end

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, name, coefficient) of the units that match, in code
        points; of overlapping units of one name the best stays (of equals the one
        that shares most, then the shortest, then the first), of several names
        those that share most bigrams."""
        low = text.lower()
        if not any(x in low for x in self.anchors):
            return []
        found, spans, words = [], [], []
        for m in _WORD.finditer(text):
            for w in words_of(m[0]):
                words.append(w)
                spans.append(m.span())
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        whole: dict = {}                     # the shortest unit of a run of words
        for a, b in units(text):
            lo, hi = bisect_left(starts, a), bisect_right(ends, b) - 1
            if lo > hi:
                continue
            if (lo, hi) not in whole or b - a < whole[lo, hi][1] - whole[lo, hi][0]:
                whole[lo, hi] = a, b
            w = words_of(text[a:b])
            if not self.anchors.isdisjoint(w):
                found += [(a, b, *x) for x in self.matches(bigrams(w))]
        for lo, hi, *x in self.windows(words):
            found.append((*whole.get((lo, hi), (starts[lo], ends[hi])), *x))
        return [u[:4] for u in chosen(found)]


def _overlapping(taken: list, start: int, end: int):
    """The units of ``taken``, disjoint and in order, that overlap a range."""
    i = bisect_left(taken, (start,))
    if i and taken[i - 1][1] > start:
        i -= 1
    while i < len(taken) and taken[i][0] < end:
        yield taken[i]
        i += 1


def chosen(found: list) -> list:
    """Of overlapping units (start, end, name, coefficient, shared bigrams) those
    that stay, in order.  Units of one name that stay are disjoint, so each is
    compared with its neighbours only and two names meet once a unit."""
    by_name: dict[str, list] = {}
    for u in sorted(found, key=lambda u: (-u[3], -u[4], u[1] - u[0], u[0], u[2])):
        taken = by_name.setdefault(u[2], [])
        if next(_overlapping(taken, u[0], u[1]), None) is None:
            insort(taken, u)
    return sorted(u for name, taken in by_name.items() for u in taken if not any(
        (v[4], v[3]) > (u[4], u[3]) for other, rest in by_name.items() if other != name
        for v in _overlapping(rest, u[0], u[1])))


def units(text: str) -> list[tuple[int, int]]:
    """Distinct spans of the lines, paragraphs and the whole of a text."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    cuts = [0] + [x for m in _BLANK_LINES.finditer(text) for x in m.span()] + [len(text)]
    out += list(zip(cuts[::2], cuts[1::2]))
    out.append((0, len(text)))
    return [u for u in dict.fromkeys(out) if u[1] > u[0]]


HIT = "array<struct<start:bigint,end:bigint,license:string,dice:double>>"
_HIT_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                 ("license", pa.string()), ("dice", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, hits`` per row: where which licence notice stands in the whole
    text, and its coefficient.  Null and empty texts have no hits; templates of
    one name are wordings of one licence; ties return every name."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def start():
        known = Templates(templates, threshold)

        def step(b: pa.RecordBatch):
            hits = [[dict(zip(("start", "end", "license", "dice"), u)) for u in known.scan(t)]
                    for t in as_texts(b.column(1))]
            return batch(b.column(0), pa.array(hits, _HIT_ARROW), names=[id_col, "hits"])
        return step
    return map_batches(rows, f"`{id_col}` {kind}, hits {HIT}", start)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("hits").cast("bigint").alias("n_hits"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))).alias("licenses"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(
            ":", h["license"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)).alias("best_dice"))
