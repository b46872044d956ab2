"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every token sequence of every template. A file's words stream
through it once; at each word it knows the longest run of words up to there that some
template contains (matching statistics). Long matches are chained, in order of their
places in one template, into the span of the template that the file covers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import ALNUM, chunks, table, text_bytes

#: Phrases that must always be found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts of public licences, without their copyright lines, and the notices by which files name them.
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License.",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}
#: A template's label needs a chain that covers this share of it.
COVER = 0.6
#: Shortest match, in words, that a chain takes, and most words of the file between two of its matches.
LEAST, GAP = 3, 12


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Automaton:
    """Suffix automaton of several token sequences, with one place in a template for every state."""

    def __init__(self, templates: dict[str, str], base: dict[str, str]):
        self.names = list(templates)
        self.base = [(tuple(words(p.encode())), label) for p, label in base.items()]
        sequences = [words(t.encode()) for t in templates.values()]
        self.sizes = [len(s) for s in sequences]
        self.most = max(self.sizes, default=0)
        vocabulary = sorted({w for s in [*sequences, *(p for p, _ in self.base)] for w in s})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        for s in [*sequences, *(list(p) for p, _ in self.base)]:
            last = 0
            for w in s:
                last = self._extend(last, self.ids[w])
        #: (template, end) places of each state
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for t, s in enumerate(sequences):
            state = 0
            for end, w in enumerate(s):
                state = self.next[state][self.ids[w]]
                v = state
                while v > 0:
                    self.places[v].add((t, end))
                    v = self.link[v]
        #: base phrases that end at a state, with their lengths: those of its suffixes too
        own: dict[int, list[int]] = {}
        for i, (p, _) in enumerate(self.base):
            state = 0
            for w in p:
                state = self.next[state][self.ids[w]]
            own.setdefault(state, []).append(i)
        self.ends: list[list[int]] = []
        for v in range(len(self.next)):
            found, u = [], v
            while u > 0:
                found += own.get(u, [])
                u = self.link[u]
            self.ends.append(found)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, c, q)
        new = self._state(self.longest[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, longest: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.longest.append(longest)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.longest[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Words; (start, phrase) of each base place; (end, length, state) of each match that no longer one follows."""
        all_words = words(text)
        get, moves, link, longest, ends = self.ids.get, self.next, self.link, self.longest, self.ends
        state = length = 0
        base, matches = [], []
        ids = list(map(get, all_words))
        for i, c in enumerate(ids):
            if c is None:
                if length >= LEAST:
                    matches.append((i - 1, length, state))
                state = length = 0
                continue
            if c in moves[state]:
                state = moves[state][c]
                length += 1
            else:
                if length >= LEAST:
                    matches.append((i - 1, length, state))
                while state > 0 and c not in moves[state]:
                    state = link[state]
                    length = longest[state]
                if c in moves[state]:
                    state = moves[state][c]
                    length += 1
            if ends[state]:
                for p in ends[state]:
                    n = len(self.base[p][0])
                    if length >= n:
                        base.append((i - n + 1, p))
        if length >= LEAST:
            matches.append((len(ids) - 1, length, state))
        return len(ids), base, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, covered words, first and last word of the file) of the best chain of each template.

        A chain takes matches in the order of the file whose ends in the template rise too, with at most GAP words of the
        file between two; words that two of them share count once. The best chain up to each (match, place) is found from
        those of the matches before it that are near enough; of equal ones the first stays.
        """
        best: dict[int, tuple[int, int, int, int]] = {}
        near: dict[int, list[tuple[int, int, int, int]]] = {}  # template: end, place, covered, first word of chains that can still go on
        for end, length, state in matches:
            start, new = end - length + 1, []
            for t, place in sorted(self.places[state]):
                open_ = near.get(t)
                covered, first = length, start
                if open_:
                    open_[:] = [c for c in open_ if c[0] >= start - 1 - GAP - self.most]
                    for e, p, had, begun in open_:
                        gain = had + min(length, place - p, end - e)
                        if p < place and start - 1 - e <= GAP and gain > covered:
                            covered, first = gain, begun
                new.append((t, (end, place, covered, first)))
                if t not in best or covered > best[t][1]:
                    best[t] = (t, covered, first, end)
            for t, c in new:
                near.setdefault(t, []).append(c)
        return sorted(best.values())


@lru_cache(maxsize=2)
def automaton(templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(templates), dict(base))


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, base places, labels, spans and score of each row's whole text.

    spans: template, covered share, first and last word of each chain that earns a label. score: the largest
    covered share, 1 if a base phrase stands in the text. Null and empty texts: no words, no labels, score 0. A null id
    stays null. Of chains that cover the same number of words the first is reported. Repeated rows give repeated results.
    Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    key = tuple((TEMPLATES if templates is None else templates).items()), tuple((BASE if base is None else base).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = automaton(*key)
        for batch in chunks(batches, "text"):
            rows = []
            for t in text_bytes(batch.column(1)):
                n, places, matches = sam.scan(t)
                spans, score = [], 1.0 if places else 0.0
                for i, covered, first, last in sam.chains(matches) if matches else ():
                    share = covered / sam.sizes[i]
                    score = max(score, min(1.0, share))
                    if share >= COVER:
                        spans.append({"template": sam.names[i], "share": min(1.0, share), "first": first, "last": last})
                own = sorted({sam.base[p][1] for _, p in places})
                rows.append((n, len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None), ",".join(own), ",".join(sorted({*own, *(s["template"] for s in spans)})), score, spans))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("template", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,share:double,first:bigint,last:bigint>>"
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: nulls, empty and long texts, ties, repeats and empty tables as in ``scan_licences``."""
    return scan_licences(table(spark, sf_dir, "documents"))
