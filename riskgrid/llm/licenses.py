"""License scans with a positional index of rare words.

Every notice template is a sequence of words. Words are weighed by their
inverse document frequency among the templates; the ``ANCHORS`` rarest of each
template form the index, each posting with its place in the template. A scan
takes the words of a text that stand in the index, rarest first, and subtracts
each posting's place from the word's place: a vote for a start of that
template. Starts that lie within ``GAP`` words of each other are one, so a few
inserted or missing words between anchors don't part them. A start with votes
of enough different anchors is verified: enough of the template's words follow
in order (longest common subsequence), and its mandatory phrases stand there.
Votes of words that lie inside a verified notice of the same template are not
looked up again.

Three base phrases are found besides, wherever their words stand in a row.

Work is one pass over the words of each text, in one task with its row;
nothing is shuffled, and the index is a few kB of code.

Defined cases: a null or empty text has no words, null places, empty labels
and score 0; very long texts are scanned whole; repeated rows are scanned each
time; places count words from 0; ids of any size stay exact; extra columns are
not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgrid.llm.common import Columns, by_rows

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

ANCHORS = 6
#: Different anchors that must agree on a start (a template of fewer words needs them all).
VOTES = 2
#: Words by which starts may differ and still be one.
GAP = 4
#: Share of a template's words that follow in order at a start.
MIN_COVER = 0.8

#: Customary notices of public licences (fixed values): label, notice, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy")),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("deal in the software", "sell copies")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("compliance with the license", "license 2 0")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("general public license", "free software foundation")),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2")),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3")),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license", "free software foundation")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    ("bsd", "licensed under the BSD license", ("bsd license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("granted to anyone", "redistribute it freely")),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
    ("cc0-1.0", "released under CC0 1.0 Universal, to the extent possible under law, dedicated to the public domain", ("cc0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("open font license",)),
    ("artistic-2.0", "licensed under the Artistic License 2.0", ("artistic license",)),
)

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters (A-Z folded) and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(_SPLIT).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    needed: int  # votes of different anchors

    def cover(self, shown: list[bytes]) -> float:
        """Share of the words that follow in order in ``shown``: a longest common subsequence, the template in the bits of one number."""
        full = (1 << len(self.words)) - 1
        at: dict[bytes, int] = {}
        for k, w in enumerate(self.words):
            at[w] = at.get(w, 0) | 1 << k
        row = full
        for w in shown:
            same = row & at.get(w, 0)
            row = (row + same | row - same) & full
        return (len(self.words) - row.bit_count()) / len(self.words)


class Spans:
    """Spans of words that don't overlap, in order; looked up by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.covers: list[float] = []

    def holds(self, i: int) -> bool:
        k = bisect_right(self.starts, i)
        return k > 0 and i < self.ends[k - 1]

    def meets(self, begin: int, end: int) -> bool:
        k = bisect_right(self.ends, begin)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, begin: int, end: int, cover: float) -> None:
        k = bisect_right(self.starts, begin)
        self.starts.insert(k, begin)
        self.ends.insert(k, end)
        self.covers.insert(k, cover)


class Index:
    def __init__(self, templates=TEMPLATES, anchors: int = ANCHORS):
        texts = [tuple(words_of(t)) for _, t, _ in templates]
        frequency = Counter(w for t in texts for w in set(t))
        self.idf = {w: math.log((1 + len(texts)) / n) for w, n in frequency.items()}
        self.templates: list[Template] = []
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)  # template, anchor, place
        for k, ((label, _, phrases), words) in enumerate(zip(templates, texts, strict=True)):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], words.index(w)))[:anchors]
            for i, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((k, rare.index(w), i))
            self.templates.append(Template(label, words, tuple(tuple(words_of(p)) for p in phrases), min(VOTES, len(rare))))
        self.starts: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = defaultdict(list)
        for p, label in BASE.items():
            phrase = tuple(words_of(p))
            self.starts[phrase[0]].append((phrase, label))

    def notices(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, cover) of all verified notices."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                places[w].append(i)
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by template: start, anchor
        found: dict[int, Spans] = defaultdict(Spans)
        anchors: dict[int, set[int]] = defaultdict(set)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            touched = set()
            for k, anchor, place in self.postings[w]:
                known = found[k]
                votes[k] += [(i - place, anchor) for i in places[w] if not known.holds(i)]
                anchors[k].add(anchor)
                touched.add(k)
            for k in touched:
                if len(anchors[k]) >= self.templates[k].needed:
                    self._verify(k, words, votes[k], found[k])
        return sorted((self.templates[k].label, *x) for k, xs in found.items() for x in zip(xs.starts, xs.ends, xs.covers, strict=True))

    def _verify(self, k: int, words: list[bytes], votes: list[tuple[int, int]], known: Spans) -> None:
        """Add to ``known`` the notices that the votes lead to."""
        t = self.templates[k]
        votes.sort()
        low = 0
        for high, (start, _) in enumerate(votes):
            while votes[low][0] < start - GAP:
                low += 1
            near = votes[low : high + 1]
            if len({a for _, a in near}) < t.needed:
                continue
            begin, end = max(near[0][0], 0), min(start + len(t.words) + GAP, len(words))
            if known.meets(begin, end):
                continue
            shown = words[begin:end]
            cover = t.cover(shown)
            if cover >= MIN_COVER and all(_stands(p, shown) for p in t.phrases):
                own = [i for i, w in enumerate(shown) if w in t.words]
                known.add(begin + own[0], begin + own[-1] + 1, cover)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        places, base = [], set()
        for i, w in enumerate(words):
            for phrase, label in self.starts.get(w, ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    places.append(i)
                    base.add(label)
        found = self.notices(words)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[0] for x in found})),
            "score": max([x[3] for x in found] + [1.0] * bool(places), default=0.0),
            "spans": [{"label": a, "start": s, "end": e, "cover": c} for a, s, e, c in found],
        }


def _stands(phrase: tuple[bytes, ...], words: list[bytes]) -> bool:
    return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,cover:double>>"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, the places and labels of the base phrases, all labels, the best agreement, and the spans of the notices."""

    def make():
        index = Index(templates)

        def work(rows: Columns) -> Iterator[dict]:
            found = [index.scan(t) for t in rows["text"]]
            yield {"doc_id": rows["doc_id"]} | {c: [x[c] for x in found] for c in found[0]}

        return work

    return by_rows(docs.select("doc_id", "text"), make, f"doc_id bigint, {COLUMNS}")
