"""Licence scan with a generalised suffix automaton of template words.

All templates (base phrases and licence texts) form one automaton over word ids. A document streams through it once; at each
word the automaton gives the matching statistic: the length of the longest run of words ending here that stands in some template.
Runs whose length reaches a base phrase's at a state of that phrase are its places. Maximal matches of at least `min_match`
words are chained in order inside one template (both positions rising, gaps of at most `max_gap` words) to covered spans; a
template of which a chain covers at least `min_cover` gives its label.

Words: lower-cased A-Z, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null texts are empty. Rows are independent: repeated ids give
repeated rows, null ids stay, an empty table gives none. The automaton's size is that of the templates, so it goes with the task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import text_bytes

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
"""Fixed values: the base phrases and their labels."""

TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "apache-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
}
"""Openings of well-known licence texts and short notices, as plain words."""

NAMES = {"gpl-notice": "gpl", "apache-notice": "apache-2", "mit-notice": "mit"}
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.6
_BLANK = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_BLANK).split()


class Automaton:
    """Generalised suffix automaton; states carry the template and the place of their first occurrence."""

    def __init__(self, templates: list[list[int]]):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [(0, 0)]
        self.templates = templates
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, (t, i))
        self.places = [set() for _ in self.next]  # (template, end) of the longest word run of a state
        for t, words in enumerate(templates):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                at = state
                while at > 0:
                    self.places[at].add((t, i))
                    at = self.link[at]
        # matches of a state: its own places at the matched length, and those of shorter suffixes along the links
        self.matches = [[(t, end, None) for t, end in sorted(self.places[0])]] + [[] for _ in self.next[1:]]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = {(t, end): None for t, end in self.places[state]}
            for t, end, length in self.matches[self.link[state]] if self.link[state] > 0 else []:
                own.setdefault((t, end), length if length is not None else self.length[self.link[state]])
            self.matches[state] = [(t, end, length) for (t, end), length in sorted(own.items())]

    def _add(self, length, link, moves, first):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p, q, w):
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last, w, first):
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = self._add(self.length[last] + 1, 0, {}, first), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def statistics(self, words):
        """(state, length) after each word: the longest suffix of what was read that stands in a template."""
        state, length = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, names=NAMES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        lines = [p.encode() for p in phrases] + [t.encode() for t in templates.values()]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for line in lines for w in line.split()))}
        texts = [[self.vocabulary[w] for w in line.split()] for line in lines]
        self.automaton, self.texts, self.n_phrases = Automaton(texts), texts, len(phrases)
        self.labels = [*phrases.values(), *(names.get(t, t) for t in templates)]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.shortest = min([min_match, *(len(t) for t in texts[:self.n_phrases])])

    def scan(self, words: list[bytes]):
        """Base places (start, phrase), and spans (first word, last word, covered words, template), in order."""
        # fromiter with map keeps the walk to runs of template words; a run shorter than every match cannot hold one
        ids = np.fromiter(map(self.vocabulary.get, words, (-1 for _ in words)), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        base, matches = [], []
        if not len(known):
            return base, []
        breaks = np.flatnonzero(np.diff(known) > 1)
        for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(known) - 1), strict=True):
            begin, stop = int(known[a]), int(known[b]) + 1
            if stop - begin < self.shortest:
                continue
            trail = list(self.automaton.statistics(ids[begin:stop].tolist()))
            for i, (state, length) in enumerate(trail):
                last = i + 1 == len(trail) or trail[i + 1][1] <= length  # the longest match ends here
                for t, end, shorter in self.automaton.matches[state]:
                    n = shorter or length
                    if t < self.n_phrases:
                        if end == len(self.texts[t]) - 1 and n > end:
                            base.append((begin + i - end, t))
                    elif last and n >= self.min_match:
                        matches.append((begin + i - n + 1, n, t, end - n + 1))
        return sorted(base), self._chained(sorted(matches))

    def _chained(self, matches):
        """Chains per template: each match continues the open chain if it lies behind it in both texts and not too far away."""
        done, chains = [], {}
        for at, length, t, place in matches:
            chain = chains.get(t)
            if chain and at >= chain[1] and place >= chain[3] and at - chain[1] <= self.max_gap and place - chain[3] <= self.max_gap:
                chain[1], chain[2], chain[3] = at + length, chain[2] + length, place + length
                continue
            if chain and at < chain[1] and length <= chain[2]:
                continue  # inside what is covered
            if chain and at >= chain[1]:
                done.append(chain)
            chains[t] = [at, at + length, length, place + length, t]
        return sorted((c[0], c[1] - 1, c[2], c[4]) for c in [*done, *chains.values()])

    def row(self, words):
        base, spans = self.scan(words)
        cover = {}
        for _, _, n, t in spans:
            cover[t] = max(cover.get(t, 0.0), n / len(self.texts[t]))
        found = {self.labels[t] for t, c in cover.items() if c >= self.min_cover}
        names = {self.labels[t] for _, t in base}
        starts = [s for s, _ in base]
        score = 1.0 if base else max(cover.values(), default=0.0)
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | found)), min(score, 1.0),
                [{"template": self.labels[t], "first": a, "last": b, "covered": n} for a, b, n, t in spans if n >= self.min_cover * len(self.texts[t])])


ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                  ("spans", pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64())])))])


def license_scan(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score, and the covered template spans."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]

    def run(batches):
        scanner = Scanner(**settings)
        for batch in batches:
            offsets, data = text_bytes(batch)
            rows = [scanner.row(words_of(bytes(data[a:b]))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            values = list(zip(*rows, strict=True)) if rows else [[] for _ in ROWS.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, ROWS.field(i + 1).type) for i, v in enumerate(values))], schema=ROWS)

    return docs.select(*columns).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                                            "spans array<struct<template: string, first: long, last: long, covered: long>>")
