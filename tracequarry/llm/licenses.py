"""License scans: matching statistics against a generalised suffix automaton of licence texts and notices.

The automaton holds every run of words of every template: whole public licence texts, and the notices that point to one.
A document's words stream through it where LEAST words in a row also stand in a template; matches that cannot be made
longer are chained, per template and with every place where it has them, in order of both texts, and a chain's share of the
template's words is its coverage. A document carries a template's label from COVERED on.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed by the contract of the base phrases, longest first.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Standard public notices by label.
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Released under the MIT License. See the LICENSE file for details.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This file is distributed under the GNU General Public License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This text is available under CC BY 4.0.",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
}
#: Files of whole licence texts, beside this module: label, two hyphens and a name.
TEXTS = "licence_texts"
#: Least words of a match, most words skipped between two matches of a chain, and coverage that gives a label.
LEAST, SKIP, COVERED = 4, 6, 0.6

_SPACE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case."""
    return text.translate(_SPACE).split()


def templates() -> dict[str, tuple[str, ...]]:
    """Notices and whole licence texts by label."""
    out = dict(NOTICES)
    for file in sorted(files(__package__).joinpath(TEXTS).iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            label = file.name.split("--")[0]
            out[label] = (*out.get(label, ()), file.read_text("utf-8"))
    return out


class Automaton:
    """Generalised suffix automaton of word-number sequences; each state knows all places (sequence, end) where its words end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at + 1))
        for state in sorted(range(len(self.link)), key=self.length.__getitem__, reverse=True):
            if state:
                self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        if (there := self.next[last].get(word)) is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            clone = self._copy(there, self.length[last] + 1)
            self._redirect(last, word, there, clone)
            self.link[there] = clone
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append(set())
        new, p = len(self.link) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._copy(q, self.length[p] + 1)
                self._redirect(p, word, q, clone)
                self.link[q] = self.link[new] = clone
        return new

    def _redirect(self, p: int, word: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(word) == old:
            self.next[p][word] = new
            p = self.link[p]

    def matches(self, sequence: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match of at least so many words that the next word does not extend."""
        state, n = 0, 0
        for i, word in enumerate(sequence):
            if n >= least and word not in self.next[state]:
                yield i, n, state
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
        if n >= least:
            yield len(sequence), n, state


class Scanner:
    def __init__(self, notices: dict[str, tuple[str, ...]], least: int = LEAST, skip: int = SKIP, covered: float = COVERED) -> None:
        self.least, self.skip, self.covered = least, skip, covered
        self.number: dict[bytes, int] = {}
        number = lambda text: [self.number.setdefault(w, len(self.number)) for w in words(text.encode())]
        pairs = [(label, number(text)) for label, many in notices.items() for text in many]
        self.labels, sequences = [p[0] for p in pairs], [p[1] for p in pairs]
        self.phrases = [(number(p), label) for p, label in PHRASES]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.runs = np.unique(np.concatenate([self._runs(np.array(s, np.int64)) for s in sequences]))

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of least words."""
        return common.rolling(common.mixed(ids.astype(np.uint64)), self.least, common.odd_weights(self.least))

    def numbers(self, own: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in own), np.int64, count=len(own))

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(word, label) of each place where a phrase stands."""
        found = []
        for phrase, label in self.phrases:
            hit = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
            for k, word in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == word
            found += [(int(i), label) for i in np.flatnonzero(hit)]
        return sorted(found)

    def spans(self, ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(label, coverage, first word, end) of the best chain of each notice."""
        own = self._runs(ids)
        hit = self.runs[np.searchsorted(self.runs[:-1], own)] == own if len(self.runs) else np.zeros(len(own), bool)
        known = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        parts: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            for end, n, state in self.automaton.matches(ids[a : b + self.least - 1].tolist(), self.least):
                for number, at in self.automaton.ends[state]:
                    parts.setdefault(number, []).append((a + end - n, a + end, at - n, at))
        out = []
        for number, own in parts.items():
            best = (0, 0, 0)
            live: list[tuple[int, int, int, int]] = []  # covered words, first word, end in document, end in notice
            for lo, hi, at, to in sorted(own):
                live = [c for c in live if lo - c[2] <= self.skip]
                got = (hi - lo, lo, hi, to)
                for c in live:
                    over = max(0, c[2] - lo, c[3] - at)
                    if c[3] < to and c[2] < hi and over < hi - lo and at - c[3] <= self.skip and c[0] + hi - lo - over > got[0]:
                        got = (c[0] + hi - lo - over, c[1], hi, to)
                live.append(got)
                best = max(best, (got[0], -got[1], got[2]))
            out.append((self.labels[number], min(1.0, best[0] / self.sizes[number]), -best[1], best[2]))
        return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, coverage: double, start: long, end: long>>"


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Licence findings of each whole text: base phrases, labels, the best coverage and the covered spans in words.

    notices: templates by label; templates() where none are given.

    A null or empty text has no words, empty labels and score 0. Texts are read whole, however long. Repeated rows give repeated
    results, and an empty table an empty one.
    """
    common.small_batches(df.sparkSession)
    given = templates() if notices is None else notices
    own_names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kept, head = common.kept_names(df, keep, own_names)
    span = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def start():
        scan = Scanner(given)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for raw in common.texts(batch.column(len(keep))):
                ids = scan.numbers(words(raw))
                base, spans = scan.base(ids), scan.spans(ids)
                own = {label for _, label in base}
                full = own | {s[0] for s in spans if s[1] >= scan.covered}
                spans = [dict(zip(("label", "coverage", "start", "end"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[2], s[3], s[0])) if s[1] >= scan.covered]
                rows.append((len(ids), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(full)), max((s["coverage"] for s in spans), default=0.0), spans))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *columns], names=[*kept, *own_names])

        return step

    return df.select(*keep, F.col(text)).mapInArrow(common.batches(start), head + SCHEMA)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence findings of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
