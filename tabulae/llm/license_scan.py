"""Operator 9: license scan as an exact set-similarity join of text blocks and templates.

Blocks are the lines of a text, and windows of words that cross line breaks, as sets of words. A
block meets a template when it holds at least ``threshold`` of the template's words. A window is
as long as the template in words, divided by ``threshold``, so a text may be wrapped anywhere. Template words are ordered by their frequency
in the whole corpus, rarest first, and three filters stand before the verification:

* prefix: a block that meets template T holds one of its |T| - need + 1 rarest words;
* length: it has at least ``need`` distinct words;
* position: from the first shared word on, enough words must remain on both sides.

The template set is code, so it is bounded (``MAX_TEMPLATES``), and goes to the workers with
the function; documents are never shuffled. Only the counts of the template words, one row
for each word, are collected.

Every template that is met gives its label, unless all the words that it shares with the block
stand in a better template that meets there too, as a shorter licence name in a longer one.

Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned each on
its own; extra columns are ignored. Equal labels from several templates are listed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.llm.common import arrow_map, limit_batches, only

MAX_TEMPLATES = 1000
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated this work has waived all copyright"),
]
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LETTERS_LINES = _LETTERS[:10] + b"\n" + _LETTERS[11:]


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of a bounded vocabulary occurs in all texts."""
    wanted = frozenset(w.encode() for w in vocabulary)
    limit_batches(docs.sparkSession, 400)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
                if not wanted.isdisjoint(words):
                    total.update(filter(wanted.__contains__, words))
        yield pa.record_batch([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = only(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


class TemplateIndex:
    """The templates' words in the global order, with an inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> None:
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.labels = [label for label, _ in templates]
        vocabulary = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
        self.order = {w.encode(): k for k, w in enumerate(vocabulary)}
        self.sets: list[list[int]] = []
        self.need: list[int] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, text) in enumerate(templates):
            words = sorted({self.order[w.encode()] for w in text.split()})
            need = math.ceil(threshold * len(words) - 1e-9)
            self.sets.append(words)
            self.need.append(need)
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((t, at))
        self.members = [frozenset(s) for s in self.sets]
        self.spans = [math.ceil(len(text.split()) / threshold - 1e-9) for _, text in templates]
        self.rare = frozenset(w for w, k in self.order.items() if k in self.prefix)

    def windows(self, words: list[bytes], line: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, start, stop, shared) of runs of windows that cross a line break and meet a
        template: the run's first window with the most shared words. ``line`` is each word's."""
        order = self.order
        places = [(i, w) for i, x in enumerate(words) if (w := order.get(x)) is not None]
        held = {w for _, w in places}
        found: list[tuple[int, int, int, int]] = []
        # as a whole the words must meet the template too, by its prefix and by their number
        for t in sorted({t for w in held for t, _ in self.prefix.get(w, ())}):
            members, need, span = self.members[t], self.need[t], self.spans[t]
            if len(members & held) < need:
                continue
            own = [(i, w) for i, w in places if w in members]
            count: dict[int, int] = {}
            low, best = 0, None
            for i, w in own:
                count[w] = count.get(w, 0) + 1
                while own[low][0] <= i - span:
                    gone = own[low][1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                    low += 1
                start = own[low][0]
                if len(count) < need or line[start] == line[i]:
                    continue
                if best is not None and start < best[2]:
                    if len(count) > best[3]:
                        best = (t, start, i + 1, len(count))
                    continue
                if best is not None:
                    found.append(best)
                best = (t, start, i + 1, len(count))
            if best is not None:
                found.append(best)
        return found

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """Containment of each template that the block of these words meets."""
        distinct = set(words)
        order = self.order
        block = sorted(order[w] for w in distinct if w in order)
        found: dict[int, float] = {}
        seen: set[int] = set()
        for i, w in enumerate(block):
            for t, at in self.prefix.get(w, ()):
                need = self.need[t]
                if t in seen or len(distinct) < need:
                    continue
                if 1 + min(len(block) - i - 1, len(self.sets[t]) - at - 1) < need:
                    continue  # this is their first shared word in the common order
                seen.add(t)
                shared = len(self.members[t].intersection(block))
                if shared >= need:
                    found[t] = shared / len(self.sets[t])
        return found


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, blocks: bool = False) -> DataFrame:
    """One row for each document with places, labels and score; with ``blocks`` one row for
    each (doc_id, line number, label, containment) instead, the join's own result; a window that
    crosses line breaks has the number of the line where it begins.

    ``score`` is the largest containment met, or 1 where a phrase stands, or 0."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    index = TemplateIndex(templates, token_counts(docs, vocabulary), threshold)
    phrases = [(label, p.encode().split()) for label, p in PHRASES.items()]
    keys = frozenset(p[-1] for _, p in phrases)

    def blocks_of(data: bytes) -> Iterator[tuple[int, dict[int, float]]]:
        """(line, containment of the templates it gives) of lines, then of windows, which begin there."""
        order = index.order
        words: list[bytes] = []
        line: list[int] = []
        met: list[tuple[int, int, int, float, frozenset[int]]] = []
        groups: list[tuple[int, list[tuple]]] = []
        for k, text in enumerate(data.translate(_LETTERS_LINES).split(b"\n")):
            own = text.split()
            if own and not index.rare.isdisjoint(own) and (found := index.matches(own)):
                block = {order[w] for w in own if w in order}
                here = [(t, len(words), len(words) + len(own), share, index.members[t] & block) for t, share in found.items()]
                met += here
                groups.append((k, here))
            words += own
            line += [k] * len(own)
        wide = []
        for t, start, stop, shared in index.windows(words, line):
            share = shared / len(index.sets[t])
            if not any(x[0] == t and x[3] >= share and x[1] < stop and start < x[2] for x in met):
                block = {order[w] for w in words[start:stop] if w in order}
                wide.append((t, start, stop, share, index.members[t] & block))
        for k, here in groups:
            # a window doesn't hide a template that stands in its line as a whole
            if left := {x[0]: x[3] for x in here if not hidden(x, here if x[3] == 1 else here + wide)}:
                yield k, left
        for x in wide:
            if not hidden(x, met + wide):
                yield line[x[1]], {x[0]: x[3]}

    def hidden(x: tuple, others: list[tuple]) -> bool:
        """Whether all that template ``x`` shares stands in a better one that meets there too."""
        t, start, stop, share, shared = x
        rank = (share, len(index.sets[t]))
        return any(shared <= o[4] and (o[3], len(index.sets[o[0]])) > rank and o[1] < stop and start < o[2] for o in others)

    def as_blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (doc, k, index.labels[t], share)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for k, found in blocks_of((text or "").encode("utf-8", "surrogatepass"))
            for t, share in sorted(found.items())
        ]
        return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "line", "label", "containment"), r)) for r in rows], pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def as_documents(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column(1).to_pylist():
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.translate(_LETTERS).split()
            places: list[int] = []
            base: set[str] = set()
            if not keys.isdisjoint(words):
                for label, phrase in phrases:
                    at, n = -1, len(phrase)
                    while True:
                        try:
                            at = words.index(phrase[0], at + 1)
                        except ValueError:
                            break
                        if words[at : at + n] == phrase:
                            places.append(at)
                            base.add(label)
            labels, score = set(base), 1.0 if base else 0.0
            if not index.rare.isdisjoint(words):
                for _, found in blocks_of(data):
                    labels.update(index.labels[t] for t in found)
                    score = max(score, *found.values())
            for col, v in zip(out, (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)):
                col.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    docs = only(docs, "doc_id", "text")
    if blocks:
        return arrow_map(docs, as_blocks, "doc_id long, line long, label string, containment double")
    return arrow_map(docs, as_documents, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
