"""License scans with a generalised suffix automaton.

The automaton holds every run of words of all license templates, so a text can be streamed
through it word by word: after each word it knows the longest run of words ending there that
stands in some template, the text's matching statistics. Runs that cannot be continued and have
``LEAST`` words or more are matches. Matches of one template that follow each other in the text
and in the template, with at most ``GAP`` strange words between, are chained into a span; a
template is found where the words of a span cover ``COVER`` of it.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 3
GAP = 12
COVER = 0.7

# Label and words of well-known notices; two templates may share a label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
                   "license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license "
                   "is distributed on an as is basis"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

# Phrases whose every place is reported.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Of a text's UTF-8 bytes: digits, lower-cased ASCII letters and all bytes of other characters make words.
WORD_BYTES = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Automaton:
    """A suffix automaton of several sequences of word numbers."""

    def __init__(self, templates):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # template -> places where the state's runs end
        for number, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = self.extend(last, word)
                self.ends[last].setdefault(number, []).append(place)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:  # a run ends wherever a longer run that it closes ends
                for number, places in self.ends[state].items():
                    own = self.ends[self.link[state]].setdefault(number, [])
                    own.extend(p for p in places if p not in own)

    def new(self, next_, link, length):
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def extend(self, last, word):
        """Add a word after state ``last``; sequences share states, so the step may exist."""
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self.clone(last, word, there)
        state = self.new({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[state] = there if self.length[there] == self.length[at] + 1 else self.clone(at, word, there)
        return state

    def clone(self, at, word, there):
        copy = self.new(dict(self.next[there]), self.link[there], self.length[at] + 1)
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def matches(self, words):
        """(end, length, state) of each run of the text that cannot be continued to the right."""
        state = length = 0
        for place, word in enumerate(words):
            if word not in self.next[state]:
                if length >= LEAST:
                    yield place - 1, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
        if length >= LEAST:
            yield len(words) - 1, length, state


class Scanner:
    """Finds phrases and templates in words."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        split = [words_of(text) for _, text in templates]
        self.phrases = [(words_of(text), label) for text, label in phrases]
        known = dict.fromkeys(w for words in [*split, *(p for p, _ in self.phrases)] for w in words)
        self.numbers = {word: n for n, word in enumerate(known, 1)}
        self.templates = [[self.numbers[w] for w in words] for words in split]
        self.automaton = Automaton(self.templates)
        self.base = len(known) + 1
        self.starts = np.unique([c for t in self.templates for c in self.triples(np.array(t)).tolist()])

    def triples(self, ids):
        return (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:]

    def numbered(self, words):
        return np.fromiter((self.numbers.get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def places(self, ids):
        """(start, label) of every place of a phrase, by start."""
        found = []
        for words, label in self.phrases:
            if len(ids) < len(words):
                continue
            n = len(ids) - len(words) + 1
            hit = np.ones(n, dtype=bool)
            for offset, word in enumerate(words):
                hit &= ids[offset : offset + n] == self.numbers[word]
            found += [(int(at), label) for at in np.flatnonzero(hit)]
        return sorted(found)

    def spans(self, ids):
        """(start, end, template, cover) of every chain; cover counts template words once.

        A match has three words or more, so a text without a template's triple has none and
        need not be streamed.
        """
        if len(ids) < LEAST or not np.isin(self.triples(ids), self.starts).any():
            return []
        matches = defaultdict(list)  # template -> (text start, template start, length) in text order
        for end, length, state in self.automaton.matches(ids.tolist()):
            for number, places in self.automaton.ends[state].items():
                for place in places:
                    matches[number].append((end - length + 1, place - length + 1, length))
        return [span for number, own in matches.items() for span in self.chained(number, own)]

    def chained(self, number, matches):
        """Greedy chains of one template: each match joins the open chain that it continues best."""
        chains: list[list[int]] = []  # text start, text end, template end, covered
        done = []
        for start, place, length in sorted(matches):
            still = []
            for chain in chains:
                (still if start - chain[1] <= GAP + 1 else done).append(chain)
            chains = still
            best, gain = None, 0
            for chain in chains:
                overlap = max(0, chain[1] - start + 1, chain[2] - place + 1)
                if place > chain[2] - length and place - chain[2] <= GAP + 1 and length - overlap > 0:
                    if chain[3] + length - overlap > gain:
                        best, gain = chain, chain[3] + length - overlap
            if best:
                best[1], best[2], best[3] = start + length - 1, place + length - 1, gain
            else:
                chains.append([start, start + length - 1, place + length - 1, length])
        words = len(self.templates[number])
        return [(c[0], c[1], number, min(1.0, c[3] / words)) for c in done + chains]


@functools.lru_cache(maxsize=2)
def scanner(templates, phrases) -> Scanner:
    """One scanner per Python worker and set of templates."""
    return Scanner(templates, phrases)


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first: int, last: int, label: string, cover: double>>"
)


def scan(df: DataFrame, key: str, text: str, templates=TEMPLATES, phrases=PHRASES, cover=COVER) -> DataFrame:
    """Key, word count, places of phrases, labels, score and covered spans of every row.

    ``score`` is 1 where a phrase stands, else the largest share of a template that one chain
    covers (0 without a match). ``spans`` lists the chains that cover ``cover`` or more.
    A null or empty text has no words, no labels and score 0. Whole texts are scanned; repeated
    rows each give a row, an empty frame none, and further columns are not read. No shuffle.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in COLUMNS.split(", ")[:7]] + ["spans"]

    def scanned(batches):
        own = scanner(templates, phrases)
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = own.numbered(words_of(text))
                places, spans = own.places(ids), own.spans(ids)
                base = {label for _, label in places}
                found = [(s, e, own.labels[n], c) for s, e, n, c in sorted(spans) if c >= cover]
                out.append(
                    (len(ids), len(places), places[0][0] if places else None, places[-1][0] if places else None)
                    + (",".join(sorted(base)), ",".join(sorted(base | {f[2] for f in found})))
                    + (1.0 if places else max((s[3] for s in spans), default=0.0),)
                    + ([dict(zip(("first", "last", "label", "cover"), f)) for f in found],)
                )
            frame = pd.DataFrame(out, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            frame.insert(0, "key", batch["key"].to_numpy())
            yield frame

    return rows.mapInPandas(scanned, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)
