"""License scan: exact set-similarity join of text blocks with license templates.

A template is a license notice, a block any run of consecutive words of one text that is at most SPAN times as long as the
template; line ends, paragraphs and marks do not matter, so a wrapped notice is found like one on one line. A block
matches a template of n distinct words when it holds at least ceil(t n) of them. Words are ordered by
their number in the whole corpus, rarest first. A block that matches holds one of the template's first
n - ceil(t n) + 1 words (prefix filter), so only the surroundings of these words are searched, and of those only the ones with
ceil(t n) words of the template (length filter). In what passes, every block is counted by a sliding window. Every template that meets the threshold somewhere in a text
gives its label; none is dropped for another one.

A label that has names (NAMES) also asks that one of them stands in the block as consecutive words, because notices of one family share
nearly all their words and those of a short notice are common ones ("released under the license"). Names are told apart by their places: one that lies inside a longer name is only a part of that ("CC BY" in "CC BY-NC"),
one that stands elsewhere counts by itself. A label with a version (VERSIONS) asks for its number, too, in the same block. A number after
"version" or "v", or directly after a name, belongs to the name that begins right after "version 3 of the", else to the last name before it, at
most REACH words back. A name without a number counts for each version.
Only words of templates matter for all of this, so the counts and templates that go to the tasks are as small as the templates.

Base labels come from phrases: the places where a phrase's words stand one after the other.

Defined results: null text is empty; a text without words has n_words 0, no places, no labels and score 0; rows
are scanned one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import runs, texts_of
from ledgerloom.llm.words import Words, find_words, plain_words

THRESHOLD = 0.8
# Words of a block for each word of the template: room for words between, such as marks of comments at wrapped lines.
SPAN = 2

# The phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short notices by which texts state their license.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0"],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "lgpl-3": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License, version 3."],
    "agpl-3": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License, version 3."],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD License."],
    "cc-by": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Names that notices must hold, or words that only this notice has, and names of licenses without a label of their own.
NAMES = {
    "mit": ["MIT License", "MIT X11 License", "MIT Expat License", "MIT style License", "associated documentation files"],
    "apache-2": ["Apache"],
    "mpl-2": ["Mozilla Public License"],
    "bsd": [
        "BSD License", "BSD style License", "BSD 2 Clause License", "BSD 3 Clause License", "BSD 2 Clause Simplified License",
        "BSD 3 Clause New or Revised License", "source and binary forms"],
    "cc0": ["CC0", "waived all copyright"],
    "unlicense": ["unencumbered software"],
    "gpl-2": ["GNU General Public License"],
    "gpl-3": ["GNU General Public License"],
    "lgpl-3": ["GNU Lesser General Public License"],
    "agpl-3": ["GNU Affero General Public License"],
    "cc-by": ["CC BY", "Creative Commons Attribution"],
    "cc-by-sa": ["CC BY-SA", "Creative Commons Attribution ShareAlike", "Creative Commons Attribution Share Alike"],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution NonCommercial", "Creative Commons Attribution Non Commercial"],
    "": ["CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND", *(f"Creative Commons Attribution {rest}" for rest in (
        "NoDerivatives", "NoDerivs", "No Derivatives", "NonCommercial ShareAlike", "Non Commercial Share Alike", "NonCommercial NoDerivatives",
        "NonCommercial NoDerivs", "Non Commercial No Derivatives"))],
}
NAMES = {label: [*names, *(n.replace("License", "Licence") for n in names if "License" in n)] for label, names in NAMES.items()}
REACH = 32
VERSIONS = {"apache-2": "2", "mpl-2": "2", "gpl-2": "2", "gpl-3": "3", "lgpl-3": "3", "agpl-3": "3"}


@dataclass
class Scanner:
    """Templates, phrases and names as numbers of words. `order` ranks the words, rarest first."""

    templates: dict[str, list[str]]
    phrases: dict[str, str]
    threshold: float
    names: dict[str, list[str]]
    versions: dict[str, str]
    order: np.ndarray | None = None

    def __post_init__(self) -> None:
        notices = [(label, plain_words(t.encode())) for label, ts in self.templates.items() for t in ts]
        phrases = [(label, plain_words(p.encode())) for p, label in self.phrases.items()]
        names = [(label, plain_words(n.encode())) for label, ns in self.names.items() for n in ns]
        marks = {v + d: d for v in ("", "v") for d in "123456789"} if self.versions else {}
        extra = [b"version", b"v", b"of", b"the", *(m.encode() for m in marks)] if marks else []
        self.vocabulary = sorted({w for _, ws in notices + phrases + names for w in ws} | set(extra))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = find_words([b" ".join(self.vocabulary)]).hashes
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.notices = [(label, np.array(sorted({number[w] for w in ws}))) for label, ws in notices]
        self.needs = [math.ceil(self.threshold * len(ws) - 1e-9) for _, ws in self.notices]
        self.spans = [SPAN * len(ws) for _, ws in notices]
        self.sequences = [(label, [number[w] for w in ws]) for label, ws in phrases]
        self.name_sequences = {tuple(number[w] for w in ws): {k for k, other in names if other == ws} for _, ws in names}
        self.marks = {number[m.encode()]: version for m, version in marks.items()}
        self.before_mark = [number[w] for w in extra[:2]]
        self.after_mark = [number[w] for w in extra[2:4]]
        if self.order is not None:
            self.rank = np.empty(len(self.vocabulary), dtype=int)
            self.rank[self.order] = np.arange(len(self.order))
            self.ordered = [sorted(self.rank[ws]) for _, ws in self.notices]
            self.member = np.zeros((len(self.notices), len(self.vocabulary)), dtype=bool)
            self.prefix = np.zeros_like(self.member)
            for t, (ws, need) in enumerate(zip(self.ordered, self.needs, strict=True)):
                self.member[t, ws] = True
                self.prefix[t, ws[:len(ws) - need + 1]] = True

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary's number of each word, -1 for others; hashes that meet are compared as text."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        known = self.by_hash[at]
        out = np.where(self.hashes[at] == words.hashes, known, -1)
        for i in np.flatnonzero(out >= 0):
            if words.data[words.starts[i]:words.ends[i]].lower() != self.vocabulary[out[i]]:
                out[i] = -1
        return out

    def matches(self, words: Words, numbers: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(text, label, containment) of every template that a block of the text matches."""
        named: dict[int, dict[str, list[tuple[int, int]]]] = {}
        begins = np.concatenate([[0], np.cumsum(words.counts())])
        for t, begin, places, ranks in self.surroundings(words, numbers):
            text, label, spans = int(words.text_of[begin]), self.notices[t][0], None
            if label in self.names:
                if text not in named:
                    a = int(begins[text])
                    named[text] = self.named(a, numbers[a:begins[text + 1]])
                spans = named[text].get(label, [])
                spans = spans[bisect_left(spans, (places[0] - self.spans[t],)):bisect_left(spans, (places[-1] + self.spans[t],))]
                if not spans:
                    continue
            most = best_block(places, ranks, self.spans[t], self.needs[t], spans)
            if most:
                yield text, label, most / len(self.ordered[t])

    def named(self, begin: int, numbers: np.ndarray) -> dict[str, list[tuple[int, int]]]:
        """Last and first places of each label's names, with their version, in one text whose first word has the place `begin`."""
        found = []
        for sequence, labels in self.name_sequences.items():
            found += [(p, p + len(sequence) - 1, labels) for p in run_places(numbers, sequence).tolist()]
        # A name inside a longer one begins with it or after it and ends no later.
        found.sort(key=lambda n: (n[0], -n[1]))
        own, reach = [], -1
        for name in found:
            if name[1] > reach:
                own.append(name)
                reach = name[1]
        first, last = [n[0] for n in own], [n[1] for n in own]
        out: dict[str, list[tuple[int, int]]] = {}
        numbered = set()
        if own and self.marks:
            for p in np.flatnonzero(np.isin(numbers, list(self.marks))).tolist():
                version, plain = self.marks[int(numbers[p])], self.vocabulary[numbers[p]].isdigit()
                k = bisect_left(last, p) - 1
                if plain and not (p and numbers[p - 1] in self.before_mark) and not (k >= 0 and last[k] == p - 1):
                    continue
                after = bisect_left(first, p + 3)
                if numbers[p + 1:p + 3].tolist() == self.after_mark and after < len(first) and first[after] == p + 3:
                    k = after
                if k < 0 or p - last[k] > REACH:
                    continue
                numbered.add(k)
                for label in own[k][2]:
                    if self.versions.get(label) == version:
                        out.setdefault(label, []).append((begin + max(p, last[k]), begin + min(p, first[k])))
        for k, (a, b, labels) in enumerate(own):
            for label in labels:
                if label not in self.versions or k not in numbered:
                    out.setdefault(label, []).append((begin + b, begin + a))
        return {label: sorted(spans) for label, spans in out.items()}

    def surroundings(self, words: Words, numbers: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(template, first word, places and ranks of its words) of the parts of texts that may hold a block of the template."""
        at = np.flatnonzero(numbers >= 0)
        ranks = self.rank[numbers[at]]
        hot = np.flatnonzero(self.prefix.any(axis=0)[ranks])
        if not len(hot):
            return
        ends = np.cumsum(words.counts())
        for t, (span, need) in enumerate(zip(self.spans, self.needs, strict=True)):
            mine = at[hot[self.prefix[t, ranks[hot]]]]
            if not len(mine):
                continue
            text = words.text_of[mine]
            begin = np.maximum(mine - span + 1, np.where(text > 0, ends[text - 1], 0))
            end = np.minimum(mine + span, ends[text])
            apart = begin[1:] >= end[:-1]
            for a, b in zip(begin[np.append(True, apart)].tolist(), end[np.append(apart, True)].tolist(), strict=True):
                low, high = np.searchsorted(at, [a, b])
                own = low + np.flatnonzero(self.member[t, ranks[low:high]])
                known = ranks[own].tolist()
                if overlap(sorted(set(known)), self.ordered[t], need):
                    yield t, a, at[own].tolist(), known

    def places(self, words: Words, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
        """Word numbers at which a phrase begins, within one text."""
        for label, sequence in self.sequences:
            at = run_places(numbers, sequence)
            yield at[words.text_of[at] == words.text_of[at + len(sequence) - 1]], label


def run_places(numbers: np.ndarray, sequence: Sequence[int]) -> np.ndarray:
    """Where the sequence stands in the numbers."""
    n = max(0, len(numbers) - len(sequence) + 1)
    at = np.flatnonzero(numbers[:n] == sequence[0])
    for j, number in enumerate(sequence[1:], 1):
        at = at[numbers[at + j] == number]
    return at


def overlap(block: list[int], template: list[int], need: int) -> list[int]:
    """Shared words of two ascending lists of ranks if there are `need` or more, else none."""
    shared: list[int] = []
    if len(block) < need:
        return shared
    i = j = 0
    while i < len(block) and j < len(template):
        if len(shared) + min(len(block) - i, len(template) - j) < need:
            return []
        if block[i] == template[j]:
            shared.append(block[i])
            i, j = i + 1, j + 1
        elif block[i] < template[j]:
            i += 1
        else:
            j += 1
    return shared if len(shared) >= need else []


def best_block(places: list[int], ranks: list[int], span: int, need: int, inside: list[tuple[int, int]] | None = None) -> int:
    """The most distinct ranks in a run of at most `span` words if they are `need` or more, else 0. Places ascend.
    With `inside`, ascending pairs of last and first places, the run must hold one of them whole."""
    held: dict[int, int] = {}
    most, i, k, latest = need - 1, 0, 0, -1
    ends = list(zip(places, ranks, strict=True))
    if inside is not None:
        ends = sorted(ends + [(b, -1) for b, _ in inside])
    for place, rank in ends:
        if rank >= 0:
            held[rank] = held.get(rank, 0) + 1
        while i < len(places) and places[i] <= place - span:
            held[ranks[i]] -= 1
            if not held[ranks[i]]:
                del held[ranks[i]]
            i += 1
        if inside is not None:
            while k < len(inside) and inside[k][0] <= place:
                latest = max(latest, inside[k][1])
                k += 1
            if latest <= max(-1, place - span):
                continue
        most = max(most, len(held))
    return most if most >= need else 0


def word_frequencies(docs: DataFrame, text: str, scanner: Scanner) -> np.ndarray:
    """How often each word of the vocabulary stands in all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scanner.vocabulary), dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in runs(texts):
                words = find_words(texts[a:b])
                numbers = scanner.numbers(words)
                total += np.bincount(numbers[numbers >= 0], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": np.arange(len(total), dtype=np.int32), "n": total})

    counts = docs.select(text).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequencies = np.zeros(len(scanner.vocabulary), dtype=np.int64)
    for row in counts:  # as many rows as the templates have words
        frequencies[row["word"]] = row["n"]
    return frequencies


SCAN = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, names: dict[str, list[str]] | None = None,
    versions: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document: its words, the places of base phrases, and all labels. The
    score is 1 with a base phrase, else the greatest containment that meets the threshold, else 0. NAMES and VERSIONS are
    those of TEMPLATES; other templates have none unless given."""
    if templates is None:
        names, versions = NAMES if names is None else names, VERSIONS if versions is None else versions
    known = (
        TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, threshold, names or {}, versions or {})
    plain = Scanner(*known)
    order = np.lexsort([np.arange(len(plain.vocabulary)), word_frequencies(docs, text, plain)])
    scanner = Scanner(*known, order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = texts_of(batch.column(1)), []
            for a, b in runs(texts):
                words = find_words(texts[a:b])
                numbers, counts = scanner.numbers(words), words.counts()
                begin = np.concatenate([[0], np.cumsum(counts)])
                starts: dict[int, list[int]] = {}
                base: dict[int, set[str]] = {}
                more: dict[int, dict[str, float]] = {}
                for at, label in scanner.places(words, numbers):
                    for place in at.tolist():
                        t = int(words.text_of[place])
                        starts.setdefault(t, []).append(place - int(begin[t]))
                        base.setdefault(t, set()).add(label)
                for t, label, score in scanner.matches(words, numbers):
                    best = more.setdefault(t, {})
                    best[label] = max(score, best.get(label, 0.0))
                for t in range(b - a):
                    own, found, labels = starts.get(t), more.get(t, {}), base.get(t, set())
                    out.append((
                        int(counts[t]), len(own or ()), min(own) if own else None, max(own) if own else None,
                        ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())),
                        1.0 if own else max(found.values(), default=0.0)))
            names = [f.split()[0] for f in SCAN.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, f"doc_id {dict(docs.dtypes)[doc_id]}, {SCAN}")
