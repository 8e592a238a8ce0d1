"""Licence scans with a generalised suffix automaton of licence tokens.

All templates and phrases are token strings of one automaton. A file is streamed through it
once: at every word the automaton holds the longest run of words up to there that occurs in any
template (matching statistics). Runs that can't be extended and have at least MIN_MATCH words
are chained, in the order of both file and template, over small gaps; a chain that covers
enough of its template is a licence span. Phrases are found on the way: a phrase occurs
wherever the automaton's state has the phrase's state among its suffix links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import fold, word_hashes

#: Words of a match that may be part of a chain, at least.
MIN_MATCH = 4
#: Words between two matches of a chain, at most, in the file and in the template.
MAX_GAP = 24
#: Share of a template that a chain must cover to count as a span.
MIN_COVER = 0.7

# The phrases of the contract with their labels, in its order.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of public licences and of common notices, with the labels of this scan.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "apache-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the "
        "GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
)


class Automaton:
    """A generalised suffix automaton of token strings.

    ``step``: transitions of each state; ``link``: suffix links; ``size``: longest string of each
    state; ``ends``: (string, last position) of each occurrence, for states whose longest string
    has MIN_MATCH tokens or more; ``marks``: (tokens, phrase) of the phrases that end there.
    """

    def __init__(self, strings: list[list[int]], phrases: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for i, string in enumerate([*strings, *phrases]):
            last = 0
            for at, token in enumerate(string):
                last = self._extend(last, token)
                if i < len(strings):
                    own.setdefault(last, []).append((i, at))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for state in sorted(range(1, len(self.step)), key=self.size.__getitem__, reverse=True):
            mine = self.ends[state] = sorted(set(self.ends[state]) | set(own.get(state, ())))
            if self.size[self.link[state]] >= MIN_MATCH:
                self.ends[self.link[state]] += mine
        at_state: dict[int, list[tuple[int, int]]] = {}
        for p, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                state = self.step[state][token]
            at_state.setdefault(state, []).append((len(phrase), p))
        self.marks: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(self.step)):
            found, s = [], state
            while s > 0:
                found += at_state.get(s, ())
                s = self.link[s]
            self.marks.append(tuple(found))

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of q for the strings that p reaches by the token."""
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.step[last].get(token)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, token)
        new = self._new(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, token)
        return new


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates, self.phrases = templates, phrases
        words = [word_hashes(fold(t)).tolist() for _, t in templates]
        known = [word_hashes(fold(p)).tolist() for p, _ in phrases]
        self.vocabulary = np.unique(np.array([w for s in [*words, *known] for w in s], dtype=np.uint64))
        number = {int(w): i for i, w in enumerate(self.vocabulary.tolist())}
        self.lengths = [len(s) for s in words]
        self.automaton = Automaton([[number[w] for w in s] for s in words], [[number[w] for w in s] for s in known])

    def scan(self, text: str | None) -> dict:
        """n_words; base: (first word, phrase) of all places; spans: (template, first, last, cover)."""
        words = word_hashes(fold(text))
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        there = self.vocabulary[at] == words if len(words) else np.zeros(0, dtype=bool)
        # a lone known word is neither a phrase nor a long match
        near = np.zeros(len(words), dtype=bool)
        near[1:] = there[:-1]
        near[:-1] |= there[1:]
        places = np.flatnonzero(there & near)
        step, link, size, marks = self.automaton.step, self.automaton.link, self.automaton.size, self.automaton.marks
        base: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # last word, words, state
        state, length, before = 0, 0, -2
        for i, token in zip(places.tolist(), at[places].tolist(), strict=True):
            if i != before + 1:
                if length >= MIN_MATCH:
                    matches.append((before, length, state))
                state, length = 0, 0
            elif token not in step[state]:
                if length >= MIN_MATCH:
                    matches.append((before, length, state))
                while state > 0 and token not in step[state]:
                    state = link[state]
                    length = size[state]
            state = step[state].get(token, 0)
            length = length + 1 if state else 0
            before = i
            for n, phrase in marks[state]:
                if n <= length:
                    base.append((i - n + 1, phrase))
        if length >= MIN_MATCH:
            matches.append((before, length, state))
        return {"n_words": len(words), "base": base, "spans": self._chains(matches)}

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Best chains, one for each template and stretch of the file, that cover enough."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for last, n, state in matches:
            for template, end in self.automaton.ends[state]:
                if end + 1 >= n:
                    by.setdefault(template, []).append((last, last - n + 1, end - n + 1, end))
        found = []
        for template, runs in by.items():
            runs.sort()
            best: list[tuple[int, int]] = []  # covered words, first word of the chain
            for j, (last, first, t_first, t_end) in enumerate(runs):
                own = (t_end - t_first + 1, first)
                for i in range(j - 1, -1, -1):
                    p_last, p_first, p_t_first, p_t_end = runs[i]
                    if first - p_last > MAX_GAP + 1 and last - p_last > MAX_GAP + self.lengths[template]:
                        break
                    skip = max(p_last - first, p_t_end - t_first) + 1  # words of this run that the earlier one has
                    if p_first < first and p_t_first < t_first and p_t_end < t_end and first - p_last <= MAX_GAP + 1 and t_first - p_t_end <= MAX_GAP + 1:
                        gain = t_end - t_first + 1 - max(0, skip)
                        if gain > 0 and best[i][0] + gain > own[0]:
                            own = (best[i][0] + gain, best[i][1])
                best.append(own)
            stretch: tuple[int, int, int, float] | None = None
            for (last, *_), (covered, first) in sorted(zip(runs, best, strict=True)):
                cover = min(1.0, covered / self.lengths[template])
                if cover < MIN_COVER:
                    continue
                if stretch and first <= stretch[2]:
                    if cover > stretch[3]:
                        stretch = (template, first, last, cover)
                    continue
                if stretch:
                    found.append(stretch)
                stretch = (template, first, last, cover)
            if stretch:
                found.append(stretch)
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])
_OUT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
])

_KIND = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, "
    "score: double, spans: array<struct<label: string, first_word: bigint, last_word: bigint, cover: double>>>"
)


def _row(text: str | None) -> dict:
    scanner = _scanner()
    got = scanner.scan(text)
    starts = [i for i, _ in got["base"]]
    base = {scanner.phrases[p][1] for _, p in got["base"]}
    spans = [{"label": scanner.templates[t][0], "first_word": a, "last_word": b, "cover": c} for t, a, b, c in got["spans"]]
    return {
        "n_words": got["n_words"], "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": max([s["cover"] for s in spans] + [0.5] * bool(starts), default=0.0), "spans": spans,
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences in every whole text.

    Columns: the id, n_words, n_base (places of PHRASES), first_word and last_word (their
    smallest and largest start, else null), base_labels and labels (distinct, sorted, joined by
    commas), score (the best cover of a template; a phrase alone counts 0.5; else 0) and spans
    (array of label, first_word, last_word, cover).

    Defined cases: null and empty texts have no words, empty labels and score 0; repeated rows
    are scanned each; other columns are not looked at.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_row(t) for t in texts.to_pylist()], _OUT)

    return docs.select(F.col(id_col), F.arrow_udf(run, _KIND)(F.col(text_col)).alias("found")).select(id_col, "found.*")
