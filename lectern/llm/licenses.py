"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds every template's words. A document's words stream through it and give matching statistics
(the longest run ending here that some template holds); long matches of one template are chained, by dynamic
programming over text and template, into covered spans (template, first word, last word); a span that covers enough of
its template adds its label. Base phrases are counted exactly. Null text counts as empty, giving no words; an empty
table gives no rows; repeated rows have a result each; a very long text streams through in one pass; of chains that
cover equally much the earliest stays; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow, slices

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public licence texts and notices, whole, by label; letters and digits of them are compared only.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License",
    ],
    "apache": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "This work is licensed under the GNU General Public License version 3",
    ],
    "lgpl": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ],
    "agpl": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies.""",
    ],
    "mpl": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at https://mozilla.org/MPL/2.0/.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}
LONG, GAP, COVER = 4, 8, 0.6  # words of a long match, words between chained matches, share of a template
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, spans array<struct<label: string, template: int, start: int, stop: int, share: double>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("share", pa.float64())]))
words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


class SuffixAutomaton:
    """Over several word sequences; a state's `ends` are (template, end position) of its longest string's places."""

    def __init__(self, sequences: list[list[str]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v] if self.link[v] > 0 else set()

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: list[str], long: int = LONG):
        """(start in words, length, places (template, end)): where a match of a template can't be continued.

        A place's match is as long as it can be on both sides, also where another template goes on.
        """
        state, size = 0, 0
        for i, w in enumerate([*words, None]):
            before, run = state, size
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if run >= long:
                goes_on = self.ends[state] if state else ()
                if over := {(k, e) for k, e in self.ends[before] if (k, e + 1) not in goes_on}:
                    yield i - run, run, over


def best_chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint chains (first, last, covered) of one template's matches (start, length, place), the best ones first.

    A chain's matches go forward in the text and in the template, at most GAP words apart in the text; of matches that
    overlap what came before only the rest counts. Dynamic programming gives each match its best chain; only matches
    that end near enough are looked at, so the work follows the text.
    """
    found = sorted(found)
    best, back, live = [], [], []
    for j, (start, size, place) in enumerate(found):
        most, by = size, -1
        live = [i for i in live if start - (found[i][0] + found[i][1]) <= GAP]
        for i in live:
            s, n, p = found[i]
            own = size - max(0, s + n - start, p + n - place)
            if s < start and p < place and own > 0 and best[i] + own > most:
                most, by = best[i] + own, i
        best.append(most)
        back.append(by)
        live.append(j)
    out, used = [], []
    for j in sorted(range(len(found)), key=lambda j: (-best[j], found[j])):
        first, k = j, j
        while k >= 0:
            first, k = k, back[k]
        span = found[first][0], found[j][0] + found[j][1]
        at = bisect(used, span)
        if (at == 0 or used[at - 1][1] <= span[0]) and (at == len(used) or span[1] <= used[at][0]):
            used.insert(at, span)
            out.append((*span, best[j]))
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.names = [(label, words_of(text.translate(ASCII_LOWER))) for label, texts in templates.items() for text in texts]
        self.automaton = SuffixAutomaton([words for _, words in self.names])
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.known = frozenset(self.automaton.next[0])

    def covered(self, words: list[str]) -> list[tuple[str, int, int, int, float]]:
        """The covered spans: (label, template, first word, word after the last, covered share of the template)."""
        at, known, found = 0, self.known, {}
        flags = [w in known for w in words] + [False]
        while True:
            try:
                at = flags.index(True, at)
            except ValueError:
                break
            end = flags.index(False, at)
            if end - at >= LONG:
                for start, size, places in self.automaton.matches(words[at:end]):
                    for k, stop in places:
                        found.setdefault(k, []).append((at + start, size, stop - size))
            at = end
        spans = [(self.names[k][0], k, first, last, done / len(self.names[k][1])) for k, own in found.items() for first, last, done in best_chains(own)]
        return sorted(spans, key=lambda s: (s[2], s[1], s[3]))

    def find(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base labels, spans)."""
        words = words_of(text.translate(ASCII_LOWER))
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = -1
            if phrase[-1] in words and phrase[0] in words:
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        starts.append(at)
                        labels.add(label)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), self.covered(words)

    def __call__(self, text: str) -> tuple:
        """The same with labels and score in place of the spans, as with_labels() derives them."""
        *base, labels, spans = self.find(text)
        more = {label for label in labels.split(",") if label} | {s[0] for s in spans if s[4] >= COVER}
        return *base, labels, ",".join(sorted(more)), min(1.0, max([0.0, *(s[4] for s in spans), *([0.5] if labels else [])]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, by SCHEMA, with labels and score."""

    def run(batches):
        scanner = Scanner()
        for doc_ids, texts in slices(batches, "doc_id", "text"):
            columns = list(zip(*map(scanner.find, (t or "" for t in texts)), strict=True))
            spans = pa.array([[dict(zip(("label", "template", "start", "stop", "share"), s, strict=True)) for s in own] for own in columns.pop()], SPANS)
            flat = arrow(SCHEMA.split(", spans")[0], [doc_ids, *columns])
            yield pa.RecordBatch.from_arrays([*flat.columns, spans], names=[*flat.schema.names, "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA).transform(with_labels)


def with_labels(rows: DataFrame) -> DataFrame:
    """Labels of base phrases and of spans that cover enough, and the score, from the spans."""
    base = F.filter(F.split("base_labels", ","), lambda label: label != "")
    enough = F.transform(F.filter("spans", lambda s: s["share"] >= COVER), lambda s: s["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(best, F.when(F.col("base_labels") != "", 0.5).otherwise(0.0)))
    return rows.withColumn("labels", F.array_join(F.array_sort(F.array_union(base, enough)), ",")).withColumn("score", score)
