"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every licence template and phrase. A text's words are streamed through it to
obtain matching statistics: for each word, the longest run ending there that some template holds. Long matches are chained
in template order into spans, by dynamic programming over their places in the text and in the template, and a span's share of
its template decides its label; a phrase is one short template that counts only as a whole.

Words outside the templates, and pairs of neighbours that no template holds, end every match; both are found in numpy on
word hashes, so only stretches of neighbouring words that a template holds are streamed word by word. Their bytes are
compared with the templates' words before that: a hash that agrees by chance counts for nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import batches_of, by_value, lower_ascii, segments, span_hashes, table, word_spans

by_value(__name__)

#: Phrases that count where their words stand in a row, and their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates of the method: (label, text). Wordings of public licences and of the notices that point to them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved."),
)
#: Whole licence bodies, public texts kept beside this module: (label, file).
BODIES = (("apache", "Apache-2.0"), ("gpl", "GPL-2"), ("gpl", "GPL-3"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3"), ("mpl", "MPL-2.0"), ("cc0", "CC0-1.0"))
#: A match counts towards a span from so many words on (or the whole template, where that is shorter).
LEAST_WORDS = 6
#: Matches of one template are chained over gaps of so many words of the text.
MOST_GAP = 24
#: A span carries its label from this share of the template on.
LEAST_SHARE = 0.6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def bodies() -> tuple[tuple[str, str], ...]:
    """The licence bodies as templates. They are read where a query is planned and travel inside the automaton."""
    return tuple((label, (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text()) for label, name in BODIES)


class Automaton:
    """Generalised suffix automaton over word numbers, with each state's first place and the phrases that end there."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.items = [(label, words_in(text), False) for label, text in templates] + [(label, words_in(text), True) for text, label in phrases]
        self.number: dict[str, int] = {}
        for _, words, _ in self.items:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.place: list[dict[int, list[int]]] = [{}]  # template -> word positions where the state's strings end
        for k, (_, words, _) in enumerate(self.items):
            state = 0
            for i, w in enumerate(words):
                state = self.extend(state, self.number[w])
                self.place[state].setdefault(k, []).append(i)
        # a state's places are also its link's
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0:
                for k, ends in self.place[s].items():
                    self.place[up].setdefault(k, []).extend(ends)
        self.place = [{k: sorted(set(v)) for k, v in p.items()} for p in self.place]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for k, (_, words, phrase) in enumerate(self.items):
            if phrase:
                state = 0
                for w in words:
                    state = self.next[state][self.number[w]]
                self.phrases[state].append((k, len(words)))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):  # a state ends with what its link ends with
            self.phrases[s] = self.phrases[s] + self.phrases[self.link[s]]
        v = len(self.number)
        self.words = [w.encode() for w in self.number]
        self.sizes = np.array([len(w) for w in self.words])
        self.pair, self.short = np.zeros((v, v), bool), np.zeros((v, v), bool)  # of neighbours; of those in phrases and short templates
        for _, words, _ in self.items:
            n = [self.number[w] for w in words]
            self.pair[n[:-1], n[1:]] = True
            if len(words) < LEAST_WORDS:
                self.short[n[:-1], n[1:]] = True
        hashes = [int(span_hashes(np.frombuffer(b := w.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0]) for w in self.number]
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.numbers = np.array(hashes, np.uint64)[order], np.arange(v)[order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes & np.uint64(0xFFFF)).astype(int)] = True

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self.clone(last, q, c)
        cur = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.place.append({})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self.clone(p, q, c)
        return cur

    def clone(self, p: int, q: int, c: int) -> int:
        new = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.place.append({})
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: state and length of the longest match that ends at each word."""
        state = n = 0
        for c in numbers:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            yield state, n

    def stretches(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[int, list[int]]]:
        """First word and word numbers of every run of words whose neighbours a template holds, where it may hold a match.

        That is: of LEAST_WORDS or more, or with two neighbours of a phrase or of a shorter template.
        """
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[maybe]
        where, number = maybe[hit], self.numbers[np.minimum(at[hit], len(self.hashes) - 1)]
        same = (ends[where] - starts[where]) == self.sizes[number]
        where, number = where[same], number[same]
        if len(where) < 2:
            return []
        joined = (where[1:] == where[:-1] + 1) & self.pair[number[:-1], number[1:]]
        d = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
        first, last = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        short = np.concatenate([[0], np.cumsum(joined & self.short[number[:-1], number[1:]])])
        keep = (last - first + 1 >= LEAST_WORDS) | (short[last] > short[first])
        out = []
        for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
            run = number[a : b + 1].tolist()
            lo, hi = starts[where[a] : where[b] + 1].tolist(), ends[where[a] : where[b] + 1].tolist()
            right = [buf[x:y].tobytes() == self.words[c] for c, x, y in zip(run, lo, hi, strict=True)]
            if all(right):
                out.append((int(where[a]), run))
                continue
            for k, ok in enumerate([*right, False]):  # a word that only hashes alike ends a run
                if not ok and k and right[k - 1]:
                    begin = max((j for j in range(k) if not right[j]), default=-1) + 1
                    out.append((int(where[a]) + begin, run[begin:k]))
        return out

    def scan(self, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Phrases ``(first word, item)`` and spans ``(item, first word, end, share of the template)`` of one text."""
        found, matches = [], []
        for first, numbers in stretches:
            stats = list(self.stream(numbers))
            for i, (state, n) in enumerate(stats):
                for k, size in self.phrases[state]:
                    if n >= size:
                        found.append((first + i - size + 1, k))
                if i + 1 == len(stats) or stats[i + 1][1] <= n:  # the match can't be made longer
                    for k, ends in self.place[state].items():
                        words, phrase = self.items[k][1], self.items[k][2]
                        if not phrase and n >= min(LEAST_WORDS, len(words)):
                            matches += [(k, first + i - n + 1, e - n + 1, n) for e in ends]
        return found, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans from matches ``(item, first word, place in the template, words)``.

        A chain is a row of matches of one template in rising order of both places, with at most MOST_GAP words of the text
        between two of them; where two overlap in either, the later one counts from the end of the earlier. Of each template
        the chains that cover most of it come first, and no two spans of it overlap.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, at, place, n in matches:
            by.setdefault(k, []).append((at, place, n))
        spans = []
        for k, own in by.items():
            own.sort()
            size, best, near = len(self.items[k][1]), [], []  # best chain that ends with each match: words covered, its first word
            for i, (at, place, n) in enumerate(own):
                near = [j for j in near if own[j][0] + own[j][2] + MOST_GAP >= at]
                most, first = n, at
                for j in near:
                    a, p, m = own[j]
                    fresh = n - max(0, a + m - at, p + m - place)
                    if fresh > 0 and place + n > p + m and best[j][0] + fresh > most:
                        most, first = best[j][0] + fresh, best[j][1]
                best.append((most, first))
                near.append(i)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(own)), key=lambda i: (-best[i][0], own[i][0])):
                covered, first = best[i]
                if covered < LEAST_SHARE * size:
                    break
                end = own[i][0] + own[i][2]
                x = bisect_left(taken, (first, end))
                if (x == len(taken) or taken[x][0] >= end) and (x == 0 or taken[x - 1][1] <= first):
                    insort(taken, (first, end))
                    spans.append((k, first, end, covered / size))
        return sorted(spans, key=lambda s: (s[1], s[0]))


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(TEMPLATES + bodies())


SCHEMA = "id {}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, template: int, first_word: bigint, end_word: bigint, share: double>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))


def scan_texts(auto: Automaton, texts: list[bytes]) -> list[tuple]:
    """Rows without their ids for whole texts of lower-cased bytes."""
    counts = np.zeros(len(texts), np.int64)
    own: list[list] = [[] for _ in texts]
    for a, b in batches_of(texts):
        if b - a == 1:
            buf = np.frombuffer(texts[a], np.uint8)
            parts = []
            for lo, hi in segments(texts[a]):
                s, e = word_spans(buf[lo:hi])
                parts.append((s + lo, e + lo, span_hashes(buf[lo:hi], s, e)))
            s, e, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts[a] = len(flat)
            own[a] = auto.stretches(buf, s, e, flat)
            continue
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        s, e = word_spans(buf)
        ends = np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts[a:b]]))
        starts = np.concatenate([[0], ends[:-1]])
        counts[a:b] = ends - starts
        for at, numbers in auto.stretches(buf, s, e, span_hashes(buf, s, e)):
            while numbers:  # a stretch ends with its text
                k = int(np.searchsorted(ends, at, side="right"))
                n = min(len(numbers), int(ends[k]) - at)
                own[a + k].append((at - int(starts[k]), numbers[:n]))
                at, numbers = at + n, numbers[n:]
    out = []
    for n, stretches in zip(counts.tolist(), own, strict=True):
        found, spans = auto.scan(stretches) if stretches else ([], [])
        base = sorted({auto.items[k][0] for _, k in found})
        labels = sorted({*base, *(auto.items[k][0] for k, *_ in spans)})
        score = 1.0 if found else round(max((s[3] for s in spans), default=0.0), 6)
        rows = [{"label": auto.items[k][0], "template": k, "first_word": f, "end_word": e, "share": round(min(share, 1.0), 6)} for k, f, e, share in spans]
        out.append((n, len(found), min((f for f, _ in found), default=None), max((f for f, _ in found), default=None), ",".join(base), ",".join(labels), min(score, 1.0), rows))
    return out


def licence_batches(auto: Automaton):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = scan_texts(auto, [lower_ascii(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()])
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *names])

    return run


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every whole text.

    Only A-Z are lower-cased. ``n_base`` counts the places of PHRASES, ``first_word`` and ``last_word`` are the smallest
    and largest of their first words (from 0; null without any), ``labels`` holds their labels and those of spans.
    ``score`` is 1 with a phrase, else the largest share of a template that a span covers, else 0. A null text counts as
    empty. Rows stay rows, repeated ones and null ids too; an empty table gives no rows, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text")
    return rows.mapInArrow(licence_batches(automaton()), SCHEMA.format(kind)).withColumnRenamed("id", id_col)


def op3_license_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document; null texts count as empty."""
    return licence_scan(table(spark, sf_dir, "documents")).drop("spans")
