"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A document's words stream through it, piece by
piece, and give matching statistics: after each word, the longest run ending there that some template has.
Long runs are chained, in order in both, into spans of a template that the document covers. The short
phrases that always label are templates too: a phrase ends wherever its state is passed with its length.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lettermill.llm.words import alnum_words

#: Phrases that label wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label. A label may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Shortest run that counts towards a template (a shorter template must match whole), words that a chain
#: may skip in the document and in the template between runs, and the share of a template to be covered.
RUN, GAP, COVER = 5, 12, 0.8


def _words(text: str) -> list[bytes]:
    return [w for piece in alnum_words(text.encode()) for w in piece]


def _apart(spans: dict[int, tuple[float, int]]) -> list[tuple[int, int, float]]:
    """Of spans by start (share, stop), those that don't overlap, larger shares first, then earlier stops."""
    taken: list[tuple[int, int, float]] = []
    for start, (share, stop) in sorted(spans.items(), key=lambda s: (-s[1][0], s[1][1], s[0])):
        i = bisect(taken, (start,))
        if (not i or taken[i - 1][1] <= start) and (i == len(taken) or stop <= taken[i][0]):
            taken.insert(i, (start, stop, share))
    return taken


@dataclass
class Automaton:
    """A suffix automaton of several word sequences. State 0 is the root."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Where a state's runs end: (template, words up to there).
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of p's runs followed by word, taken out of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = own
            p = self.link[p]
        return own

    def add(self, template: int, words: list[bytes]) -> None:
        last = 0
        for at, word in enumerate(words, 1):
            if word in self.step[last]:
                last = self._split(last, word, self.step[last][word])
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.step[p][word])
                last = new
            self.ends[last].add((template, at))

    def close(self) -> None:
        """Give every state the ends of the states whose suffix it is."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def statistics(self, pieces: Iterator[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(words so far, state, length of the longest run ending here) wherever that length isn't 0."""
        step, link, length = self.step, self.link, self.length
        at = state = run = 0
        first = step[0]
        for words in pieces:
            for at, word in enumerate(words, at + 1):  # noqa: B020, PLW2901
                if not state and word not in first:
                    continue
                while state and word not in step[state]:
                    state = link[state]
                    run = length[state]
                nxt = step[state].get(word)
                if nxt is None:
                    run = 0
                else:
                    state, run = nxt, run + 1
                    yield at, state, run


class Scanner:
    """Scans documents for phrases and templates."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], run: int = RUN, gap: int = GAP, cover: float = COVER):
        self.run, self.gap, self.cover = run, gap, cover
        self.phrases = [(_words(p), label) for p, label in phrases.items()]
        self.templates = [(_words(t), label) for label, t in templates]
        self.auto = Automaton()
        for i, (words, _) in enumerate(self.phrases + self.templates):
            self.auto.add(i, words)
        self.auto.close()
        self.sizes = [len(w) for w, _ in self.phrases + self.templates]
        k = len(self.phrases)
        # Phrases, and whole templates, that end at a state or at one of its suffixes.
        self.ending: list[list[int]] = [[] for _ in self.auto.ends]
        for state in sorted(range(1, len(self.auto.ends)), key=lambda s: self.auto.length[s]):
            whole = [i for i, at in sorted(self.auto.ends[state]) if at == self.sizes[i] and self.auto.length[state] >= at > self.auto.length[self.auto.link[state]]]
            self.ending[state] = [*self.ending[self.auto.link[state]], *whole]
        # The shortest run that counts for one of a state's templates.
        self.least = [min((min(run, self.sizes[i]) for i, _ in e if i >= k), default=1 << 60) for e in self.auto.ends]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words; places (phrase, start); spans (template, start, stop, share of it covered)."""
        k, total = len(self.phrases), 0
        places: list[tuple[int, int]] = []
        chains: dict[int, list[tuple[int, int, int, int]]] = {}
        # Of each template, by start: the share covered at most, and where that ends.
        spans: dict[int, dict[int, tuple[float, int]]] = {}

        def counted() -> Iterator[list[bytes]]:
            nonlocal total
            for words in alnum_words(text):
                total += len(words)
                yield words

        def ended(at: int, state: int, run: int) -> None:
            """A run that can't be extended: chain it in each template that has it or a long suffix of it."""
            below: set[tuple[int, int]] = set()
            while state and run >= self.least[state]:
                for i, end in self.auto.ends[state] - below:
                    if i >= k and run >= min(self.run, self.sizes[i]):
                        chained(at, i, end, run)
                below = self.auto.ends[state]
                state = self.auto.link[state]
                run = min(run, self.auto.length[state])

        def chained(at: int, i: int, end: int, run: int) -> None:
            begin, best = at - run, (run, at - run)
            # Extends a chain that stops shortly before, in the document and in the template.
            for covered, start, stop, upto in chains.get(i, ()):
                fresh = min(run, at - stop, end - upto)
                if fresh > 0 and begin - stop <= self.gap and end - run - upto <= self.gap and covered + fresh > best[0]:
                    best = (covered + fresh, start)
            live = [c for c in chains.get(i, ()) if at - c[2] <= self.gap + self.sizes[i]]
            chains[i] = [*live, (*best, at, end)]
            share = min(1.0, best[0] / self.sizes[i])
            spanned(i, best[1], at, share)

        def spanned(i: int, start: int, stop: int, share: float) -> None:
            if share >= self.cover and share > spans.setdefault(i, {}).get(start, (0.0,))[0]:
                spans[i][start] = (share, stop)

        last = (0, 0, 0)
        for now in self.auto.statistics(counted()):
            at, state, run = now
            for i in self.ending[state]:
                size = self.sizes[i]
                if run >= size and i < k:
                    places.append((i, at - size))
                elif run >= size:
                    spanned(i, at - size, at, 1.0)
            if last[2] and (at != last[0] + 1 or run != last[2] + 1) and last[2] >= self.least[last[1]]:
                ended(*last)
            last = now
        if last[2] >= self.least[last[1]]:
            ended(*last)
        return total, places, [(i - k, a, b, share) for i, found in sorted(spans.items()) for a, b, share in _apart(found)]


@cache
def default_scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


_SPAN = StructType([StructField("label", StringType()), StructField("template", LongType()), StructField("start", LongType()), StructField("stop", LongType()), StructField("cover", DoubleType())])
FOUND = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(_SPAN)),
])


def _report(scanner: Scanner, text: bytes | None) -> dict:
    total, places, spans = scanner.scan(text)
    base = {scanner.phrases[i][1] for i, _ in places}
    own = {scanner.templates[i][1] for i, *_ in spans}
    starts = [a for _, a in places]
    return {
        "n_words": total, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | own)), "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
        "spans": [{"label": scanner.templates[i][1], "template": i, "start": a, "stop": b, "cover": c} for i, a, b, c in spans],
    }


def found(text: Column, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> Column:
    """What a text column holds, as a struct (FOUND).

    Places count once per occurrence, overlapping ones too; words count from 0. base_labels and labels are
    distinct, sorted and comma-joined ('' for none). spans are all places, apart from each other, where
    enough of a template is covered, by template and start. score is 1 where a phrase stands, else the largest
    covered share of a template of which enough is covered, else 0. A null or empty text has no words.
    """
    own = phrases is not None or templates is not None

    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases or {}, templates or []) if own else default_scanner()
        for part in parts:
            rows = [_report(scanner, t) for t in part]
            out = pd.DataFrame(rows, columns=FOUND.names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    scanned.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scanned, FOUND)(text.cast("binary"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with a column licenses (see found). All columns stay; rows stay as they are."""
    return docs.withColumn("licenses", found(F.col("text"), phrases, templates))
