"""Licence scans by a generalised suffix automaton over the words of licence templates.

All templates and phrases make one automaton. A text is streamed through it word by word, which gives its
matching statistics: at each word the longest run that ends there and stands in some template, and,
along suffix links, the longest run for every place of every template. Runs that cannot go on are the maximal
matches; those of at least ``LEAST_WORDS`` words are chained template by template: ascending in text and template, an overlap
counted once, the most covered words, at most ``GAP`` words of text between two. A chain is a span with the share of the template that it
covers. Phrases (the base) are found at every place where their words stand consecutively, by the
same stream: a phrase ends where its state is the present one or an ancestor of it.

A text's score is the greatest share covered of any template or phrase; its labels are those of phrases and of
chains with ``SHARE`` or more.

No rows are shuffled; a task holds the automaton (two states a template word at most) and one text's words.

Defined results: null and empty texts have no words, labels or places and score 0; a null doc_id is kept; repeated
rows give a row each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_batches, text_or_empty

LEAST_WORDS, GAP, SHARE = 4, 30, 0.6

#: The base's phrases by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Passages of public licence texts and the notices that apply them, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
}

#: A-Z as a-z, other ASCII but digits and letters as blanks; bytes of other characters stay, so their words do.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text: runs of digits, letters a-z (A-Z folded) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """The generalised suffix automaton of some word lists, with the places where each state's runs end."""

    def __init__(self, lists: list[list[bytes]]):
        self.lists = lists
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (list, place) of the prefix that made the state
        for t, own in enumerate(lists):
            last = 0
            for place, word in enumerate(own):
                last = self._grown(last, word)
                self.ends[last].append((t, place))
        self.below: list[list[int]] = [[] for _ in self.link]
        for v, up in enumerate(self.link):
            if up >= 0:
                self.below[up].append(v)
        self.known: dict[int, list[tuple[int, int]]] = {}

    def _new(self, size: int, link: int, step: dict[bytes, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the runs of ``q`` that are no longer than those of ``p`` and the word."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._new(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _grown(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, self.step[last][word], word)
        new, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][word], word)
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """(list, place of the last word) wherever the state's runs stand."""
        if state not in self.known:
            found, left = [], [state]
            while left:
                v = left.pop()
                found += self.ends[v]
                left += self.below[v]
            self.known[state] = found
        return self.known[state]

    def state(self, run: list[bytes]) -> int:
        v = 0
        for w in run:
            v = self.step[v][w]
        return v


Match = tuple[int, int, int, int]  # first and last word in the text, first and last in the template


class Scanner:
    """Places of phrases and spans of templates in texts."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int = LEAST_WORDS, gap: int = GAP):
        self.least, self.gap = least, gap
        self.labels = [*templates, *phrases]
        self.n_templates = len(templates)
        self.automaton = Automaton([words(t) for t in [*templates.values(), *phrases.values()]])
        lists, a = self.automaton.lists, self.automaton
        self.needs = [min(least, len(x)) for x in lists]  # a template shorter than that must stand whole
        self.shortest = min(self.needs[: self.n_templates], default=0)
        own: dict[int, list[int]] = {}
        for t in range(self.n_templates, len(lists)):
            own.setdefault(a.state(lists[t]), []).append(t)
        self.phrases: list[list[int]] = []  # phrases that may end in a state
        for v in range(len(a.link)):
            found = []
            while v > 0:
                found += own.get(v, [])
                v = a.link[v]
            self.phrases.append(found)
        self.most = max(map(len, self.phrases), default=0)

    def stream(self, text: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[Match]]]:
        """(first word, phrase) of every phrase, and the maximal matches of every template, by their last word."""
        a, lists = self.automaton, self.automaton.lists
        step, link, size, phrases, shortest = a.step, a.link, a.size, self.phrases, max(1, self.shortest)
        root, places, matches = step[0], [], {}
        known, state, length = set(root), 0, 0
        for at, word in enumerate(text):
            if word not in known:
                state = length = 0
                continue
            while word not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state][word]
            length += 1
            for t in phrases[state]:
                if length >= len(lists[t]):
                    places.append((at + 1 - len(lists[t]), t))
            if length >= shortest:
                self._maximal(state, length, at, text[at + 1] if at + 1 < len(text) else None, matches)
        return places, matches

    def _maximal(self, state: int, length: int, at: int, following: bytes | None, matches: dict[int, list[Match]]) -> None:
        """The runs that end here and stand in a template that goes on otherwise: the longest for every place there."""
        a, seen = self.automaton, set()
        while state > 0 and length >= self.shortest:
            for t, place in a.places(state):
                if t >= self.n_templates or (t, place) in seen:
                    continue
                seen.add((t, place))
                own = a.lists[t]
                if length >= self.needs[t] and (place + 1 == len(own) or own[place + 1] != following):
                    matches.setdefault(t, []).append((at + 1 - length, at, place + 1 - length, place))
            state = a.link[state]
            length = a.size[state]

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int]]]:
        """Phrases, and (template, first and last word, first and last template word, words covered) of every chain."""
        places, matches = self.stream(text)
        found = []
        for t in sorted(matches):
            group: list[Match] = []
            end = None
            for m in matches[t]:
                if end is not None and m[0] - end - 1 > self.gap:
                    found.append((t, *chain(group, len(self.automaton.lists[t]))))
                    group = []
                group.append(m)
                end = m[1]
            found.append((t, *chain(group, len(self.automaton.lists[t]))))
        return places, found


def chain(matches: list[Match], size: int) -> tuple[int, int, int, int, int]:
    """(first and last word, first and last template word, covered) of the chain that covers most; matches ascend by last word.

    A match that follows another counts what is new in text and template alike.
    """
    reach: list[tuple | None] = [None] * size  # by last template word, chains that ended before any match from here on: (covered, -first word, template word)
    done: list[tuple[Match, tuple]] = []
    closed, best = 0, None
    for first, last, low, high in matches:
        while closed < len(done) and done[closed][0][1] <= last - size:
            m, x = done[closed]
            if reach[m[3]] is None or x > reach[m[3]]:
                reach[m[3]] = x
            closed += 1
        own = high - low + 1
        here = (own, -first, -low)
        for p in range(high):
            if reach[p] is not None:
                c, f, q = reach[p]
                here = max(here, (c + min(own, high - p), f, q))
        for m, (c, f, q) in done[closed:]:  # they may overlap this one in the text
            if m[1] < last and m[3] < high and (new := own - max(0, m[1] - first + 1, m[3] - low + 1)) > 0:
                here = max(here, (c + new, f, q))
        done.append(((first, last, low, high), here))
        if best is None or here[0] > best[0][0]:
            best = (here, last, high)
    (covered, first, low), last, high = best
    return -first, last, -low, high, covered


SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, spans: every phrase (``base``) and chain, with its words in the text and in the template."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        sizes, labels = [len(x) for x in scanner.automaton.lists], scanner.labels
        for b in slices(batches):
            n_words, spans = [], []
            for text in b["text"]:
                own = words(text.as_py())
                places, chains = scanner.spans(own)
                n_words.append(len(own))
                found = [(labels[t], True, at, at + sizes[t] - 1, 0, sizes[t] - 1, sizes[t], 1.0) for at, t in places]
                found += [(labels[t], False, first, last, low, high, covered, covered / sizes[t]) for t, first, last, low, high, covered in chains]
                spans.append([dict(zip(SPAN.names, x)) for x in found])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "spans"])

    kind = "array<struct<label:string,base:boolean,first_word:bigint,last_word:bigint,from_word:bigint,to_word:bigint,covered:bigint,share:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, n_words long, spans {kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")


def report(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    base = F.filter("spans", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first_word"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _joined(base).alias("base_labels"),
        _joined(F.filter("spans", lambda x: x["share"] >= share)).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
