"""Licence passages in texts by matching statistics against a generalised suffix automaton.

The automaton holds the words of all templates and base phrases. Streaming a text through it gives, at every word, the
longest run of words ending there that occurs in some template. Base phrases are the states' suffixes; long maximal
matches are chained, in order and with small gaps, into spans that cover a template. Words outside the templates and
word pairs that no template has cannot lie inside a match of two words, so only the runs between them are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.textwords import text_batches, words_of

# Phrases with their labels, and licence wording with its labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "copyright all rights reserved"),
)
MIN_MATCH = 4
MAX_GAP = 8
COVERED = 0.6

SCHEMA = (
    "doc_id long, n_words long, base array<struct<label:string,word:long>>, "
    "spans array<struct<label:string,template:int,first:long,last:long,covered:long,coverage:double>>"
)


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of integers."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: list[list[tuple[int, int]]] = [[]]  # (sequence, end) at which the state's longest string was made
        for number, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol, own)
                own[last].append((number, end))
        self.children: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                self.children[up].append(state)
        self.own = own
        self.places = lru_cache(maxsize=65536)(self._places)

    def _clone(self, q: int, length: int, own: list) -> int:
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        own.append([])
        return len(self.link) - 1

    def _redirect(self, p: int, symbol: int, old: int, new: int) -> None:
        while p >= 0 and self.step[p].get(symbol) == old:
            self.step[p][symbol] = new
            p = self.link[p]

    def _extend(self, last: int, symbol: int, own: list) -> int:
        if symbol in self.step[last]:
            q = self.step[last][symbol]
            if self.length[q] == self.length[last] + 1:
                return q
            fresh = self._clone(q, self.length[last] + 1, own)
            self.link[q] = fresh
            self._redirect(last, symbol, q, fresh)
            return fresh
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        own.append([])
        new, p = len(self.link) - 1, last
        while p >= 0 and symbol not in self.step[p]:
            self.step[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][symbol]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                fresh = self._clone(q, self.length[p] + 1, own)
                self.link[q] = self.link[new] = fresh
                self._redirect(p, symbol, q, fresh)
        return new

    def advance(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """Matching statistics after one more symbol."""
        while state and symbol not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        if symbol in self.step[state]:
            return self.step[state][symbol], length + 1
        return 0, 0

    def _places(self, state: int) -> list[tuple[int, int]]:
        """All (sequence, end) where the state's strings occur."""
        found, todo = [], [state]
        while todo:
            s = todo.pop()
            found += self.own[s]
            todo += self.children[s]
        return sorted(found)


class LicenceIndex:
    """Automaton of templates and phrases, their vocabulary, and the phrases that end in each state."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        texts = [t for t, _ in phrases] + [t for _, t in templates]
        hashes, at = words_of([t.encode() for t in texts])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        sequences = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        self.phrases, self.labels = len(phrases), [l for _, l in phrases] + [l for l, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        pairs = {(a, b) for s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), dtype=np.int64)
        opening = {(s[0], s[1]) for s in sequences[: self.phrases] if len(s) > 1}
        self.opening = np.array(sorted(a * len(self.vocabulary) + b for a, b in opening), dtype=np.int64)
        self.single = np.array(sorted({s[0] for s in sequences[: self.phrases] if len(s) == 1}), dtype=np.int64)
        # Phrases that are suffixes of a state's strings: the phrase's state and all below it in the link tree.
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for k, s in enumerate(sequences[: self.phrases]):
            state = 0
            for symbol in s:
                state = self.automaton.step[state][symbol]
            todo = [state]
            while todo:
                x = todo.pop()
                self.ending[x].append((k, len(s)))
                todo += self.automaton.children[x]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _runs(self, ids: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Word ranges that may hold a match: all neighbouring pairs occur in templates."""
        n = len(ids)
        if not n:
            return []
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        border = at[1:-1]
        border = border[(border > 0) & (border < n)]
        joined[border - 1] = False
        where = np.flatnonzero(joined)
        code = ids[where] * len(self.vocabulary) + ids[where + 1]
        joined[where] = np.isin(code, self.pairs)
        first = np.isin(code, self.opening)
        useful = np.zeros(n + 1, dtype=np.int64)
        useful[where[first] + 1] += 1
        useful[1:] += np.isin(ids, self.single)
        useful = np.cumsum(useful)
        cut = np.concatenate(([0], np.flatnonzero(~joined) + 1, [n]))
        a, b = cut[:-1], cut[1:]
        keep = (b - a >= least) | (useful[b] > useful[a])
        return list(zip(a[keep].tolist(), b[keep].tolist()))

    def scan(self, texts: list[bytes | None], least: int, gap: int, covered: float) -> list[tuple[int, list, list]]:
        """Of each text: number of words, base places (label, word), covered spans."""
        hashes, at = words_of(texts)
        ids = self.ids(hashes)
        out = [(int(b - a), [], []) for a, b in zip(at[:-1], at[1:])]
        matches: dict[int, list[tuple[int, int, int]]] = {}
        advance, ending = self.automaton.advance, self.ending
        for a, b in self._runs(ids, at, least):
            doc = int(np.searchsorted(at, a, side="right")) - 1
            origin, state, length = int(at[doc]), 0, 0
            run = ids[a:b].tolist()
            for i, symbol in enumerate(run):
                was, before = state, length
                state, length = advance(state, length, symbol) if symbol >= 0 else (0, 0)
                if before >= least and length != before + 1:
                    matches.setdefault(doc, []).append((a + i - before - origin, before, was))
                for k, size in ending[state]:
                    if size <= length:
                        out[doc][1].append((self.labels[k], a + i + 1 - size - origin))
            if length >= least:
                matches.setdefault(doc, []).append((b - length - origin, length, state))
        for doc, found in matches.items():
            out[doc][2].extend(self.chains(found, gap, covered))
        return out

    def chains(self, matches: list[tuple[int, int, int]], gap: int, covered: float) -> list[tuple]:
        """Best chains per template of (text word, words, state) matches, in text order.

        A match follows another one of its template if it comes later in both, without overlap, and at most
        ``gap`` words are left out in either.
        """
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, length, state in matches:
            for number, end in self.automaton.places(state):
                if number >= self.phrases:
                    by_template.setdefault(number, []).append((first, end - length, length))
        spans = []
        for number, parts in by_template.items():
            parts.sort()
            total, origin, low = [], [], 0
            for k, (first, place, length) in enumerate(parts):
                while parts[low][0] + parts[low][2] + gap < first and low < k:
                    low += 1
                best, start = 0, first
                for j in range(low, k):
                    f, p, l = parts[j]
                    if 0 <= first - f - l <= gap and 0 <= place - p - l <= gap and total[j] > best:
                        best, start = total[j], origin[j]
                total.append(best + length)
                origin.append(start)
            ends: dict[int, tuple[int, int]] = {}
            for (first, _, length), t, o in zip(parts, total, origin):
                ends[o] = max(ends.get(o, (0, 0)), (t, -(first + length - 1)))
            for o, (t, last) in sorted(ends.items()):
                if t >= covered * self.sizes[number]:
                    spans.append((self.labels[number], number - self.phrases, o, -last, t, t / self.sizes[number]))
        return spans


@lru_cache(maxsize=8)
def licence_index(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> LicenceIndex:
    return LicenceIndex(phrases, templates)


def scan_licences(docs: DataFrame, phrases: tuple = BASE_PHRASES, templates: tuple = TEMPLATES, least: int = MIN_MATCH,
                  gap: int = MAX_GAP, covered: float = COVERED) -> DataFrame:
    """Base phrases and covered template spans of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, base (label and first word of every place where a phrase stands), spans (label, template
    number, first and last word, covered words, coverage: part of the template that a chain of matches of at least ``least``
    words covers, if at least ``covered``). Words count from 0. Null and empty texts have no words, places or spans.
    Every row gives one row, repeated rows too.
    """
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = licence_index(tuple(phrases), tuple(templates))
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                found = index.scan(texts, least, gap, covered)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([[{"label": l, "word": w} for l, w in f[1]] for f in found], base_type),
                     pa.array([[dict(zip(("label", "template", "first", "last", "covered", "coverage"), s)) for s in f[2]] for f in found], spans_type)],
                    ["doc_id", "n_words", "base", "spans"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, SCHEMA)


def licence_summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score per document: the largest coverage of any span, 1 where a base phrase stands."""
    place, span = F.col("base.word"), F.col("spans.label")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", span)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )
