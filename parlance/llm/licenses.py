"""License scans by a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates; its size is bounded by
the template words (``MOST_WORDS``). A text streams through it word by word:
the matching statistic of a place is the longest run ending there that occurs
in some template. A word of no template resets it, so only runs of template
words are streamed. Runs of ``LONG`` words or more (or of a whole shorter
template) that the next place does not prolong are long matches; for each
template those in the same order in text and template are chained, and the
template words under the best chain are its coverage. A template is reported
at ``COVERED`` of its words.

Base phrases are found beside it at all their places, in the same pass over
the words; their labels always stay.

Defined results: a null, empty or wordless text has no words, no labels, null
first_word and last_word and score 0. Repeated rows and null ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import prepare

LONG, COVERED = 4, 0.8
MOST_WORDS = 100_000

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licences and of the notices that name them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

# Letters A-Z lowered; all ASCII but letters and digits become spaces; other bytes stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over words; states know where in which templates their runs end."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        words = [words_of(text.encode()) for _, text in templates]
        self.sizes = [len(w) for w in words]
        if sum(self.sizes) > MOST_WORDS:
            raise ValueError(f"over {MOST_WORDS} template words")
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, template in enumerate(words):
            state = 0
            for at, word in enumerate(template):
                state = self._extend(state, word)
                self.ends[state].append((t, at + 1))
        # A state's runs are suffixes of those of the states that link to it.
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []
        self.words = frozenset(w for template in words for w in template)
        self.least = min([LONG, *self.sizes])

    def _new(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, before: int, word: bytes, old: int) -> int:
        """The state for runs of ``old`` that are one word longer than ``before``'s, made if it is not there."""
        if self.length[old] == self.length[before] + 1:
            return old
        clone = self._new(self.length[before] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = clone
        while before >= 0 and self.step[before].get(word) == old:
            self.step[before][word] = clone
            before = self.link[before]
        return clone

    def _extend(self, state: int, word: bytes) -> int:
        if word in self.step[state]:  # another template has this run
            return self._split(state, word, self.step[state][word])
        new = self._new(self.length[state] + 1, {}, 0)
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.step[state][word])
        return new

    def long_matches(self, words: list[bytes], start: int) -> list[tuple[int, int, int]]:
        """(end in the text, length, state) of the runs of a stretch that are not prolonged by the next word."""
        out, state, length = [], 0, 0
        for at, word in enumerate(words):
            reached, size = state, length
            while reached and word not in self.step[reached]:
                reached = self.link[reached]
                size = self.length[reached]
            if word in self.step[reached]:
                reached, size = self.step[reached][word], size + 1
            if length >= self.least and size <= length:
                out.append((start + at, length, state))
            state, length = reached, size
        if length >= self.least:
            out.append((start + len(words), length, state))
        return out


def chained(matches: list[tuple[int, int, int]]) -> int:
    """Template words under a chain of (text end, template end, length), ascending in both.

    For each template place the best chain that ends there is kept, so the work
    grows with the matches times the template's words.
    """
    best: dict[int, tuple[int, int]] = {}  # template end: words, text end
    for end, place, length in sorted(set(matches)):
        gain = length
        for p, (words, e) in best.items():
            if p < place and e < end:
                # An overlap, in text or template, counts once.
                gain = max(gain, words + min(length, place - p, end - e))
        if gain >= best.get(place, (0, 0))[0]:
            best[place] = (gain, end)
    return max((words for words, _ in best.values()), default=0)


def scan_text(automaton: Automaton, text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
    words = words_of(text)
    places: dict[str, list[int]] = {}
    lowered = None
    for phrase, label in PHRASES.items():
        parts = [p.encode() for p in phrase.split()]
        if lowered is None:
            lowered = set(words)
        if all(p in lowered for p in parts):
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    places.setdefault(label, []).append(at)
    known = automaton.words
    found: dict[int, list[tuple[int, int, int]]] = {}
    at, n = 0, len(words)
    inside = [i for i, w in enumerate(words) if w in known]
    k = 0
    while k < len(inside):
        j = k
        while j + 1 < len(inside) and inside[j + 1] == inside[j] + 1:
            j += 1
        if j - k + 1 >= automaton.least:
            stretch = words[inside[k] : inside[j] + 1]
            for end, length, state in automaton.long_matches(stretch, inside[k]):
                for t, place in automaton.ends[state]:
                    run = min(length, place)
                    if run >= min(LONG, automaton.sizes[t]):
                        found.setdefault(t, []).append((end, place, run))
        k = j + 1
    labels, score = set(places), 0.0
    for t, matches in found.items():
        cover = min(1.0, chained(matches) / automaton.sizes[t])
        if cover >= COVERED:
            labels.add(automaton.labels[t])
        score = max(score, cover)
    starts = [s for p in places.values() for s in p]
    if starts:
        score = 1.0
    return (
        n, len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(places)), ",".join(sorted(labels)), score,
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    prepare(docs.sparkSession)
    templates = templates or TEMPLATES
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            found = [scan_text(automaton, t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    return rows.mapInArrow(run, schema)
