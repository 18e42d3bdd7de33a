"""Licence scans by a positional index of rare licence words.

Templates are licence sentences and paragraphs. Each key phrase has an anchor, its word of
the highest inverse document frequency (counted over all documents), which is
looked up in every file and verified word for word. Around each place of a key
phrase the postings of its templates are intersected by relative position (the
place in the file less the place in the template must agree), and a template is
kept whose agreeing words cover enough of it. The frequencies only choose and
order anchors: what a file is labelled depends on that file alone. The phrases of
the base rule have anchors of the same kind, so each of their places is found.

Null texts count as empty: no words, no labels, score 0. Repeated rows are each
scanned; other columns are ignored; an empty table gives an empty result. Very long
texts are scanned whole. Of words of equal rarity the first is a phrase's anchor; a
label that several templates give has the largest share found, and the score is the
largest of all.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Template, label, mandatory key phrases (one of them must stand in the file).
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted",)),
    ("released under the mit license", "mit", ("mit license",)),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license version 2", "apache license 2")),
    ("you may not use this file except in compliance with the license", "apache-2.0", ("in compliance with the license",)),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("general public license version 3", "gplv3", "gpl version 3")),
    ("either version 3 of the license or at your option any later version", "gpl-3.0", ("version 3 of the license",)),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ("general public license version 2", "gplv2", "gpl version 2")),
    ("either version 2 of the license or at your option any later version", "gpl-2.0", ("version 2 of the license",)),
    ("gnu lesser general public license", "lgpl", ("lesser general public license",)),
    ("gnu affero general public license", "agpl", ("affero general public license",)),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc 4",)),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", ("cc by nc sa 4",)),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0", ("cc by nc nd 4",)),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("cc by sa 4",)),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", ("cc by nd 4",)),
    ("licensed under cc by 4 0", "cc-by-4.0", ("cc by 4",)),
    ("licensed under cc0 1 0 universal", "cc0-1.0", ("cc0 1",)),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0", ("attribution noncommercial 4",)),
    ("creative commons attribution 4 0 international license", "cc-by-4.0", ("attribution 4",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution and use in source and binary forms",)),
    ("released under the bsd license", "bsd", ("bsd license",)),
    ("mozilla public license version 2 0", "mpl-2.0", ("mozilla public license",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("permission to use copy modify",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered software",)),
    # paragraphs of whole licence texts
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", ("this permission notice shall be included",)),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit", ("particular purpose and noninfringement",)),
    ("without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit", ("merge publish distribute sublicense",)),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0", ("distributed under the license is distributed",)),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", ("redistributions of source code must retain",)),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "bsd", ("redistributions in binary form must reproduce",)),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", ("terms of the gnu general public license",)),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl", ("distributed in the hope that it will be useful",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("subject to the terms of the mozilla public license",)),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial", "unlicense", ("modify publish use compile sell",)),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", ("in no event will the authors be held liable",)),
    ("boost software license version 1 0", "bsl-1.0", ("boost software license",)),
    ("eclipse public license v 2 0", "epl-2.0", ("eclipse public license v 2", "eclipse public license version 2", "eclipse public license 2")),
]

#: Share of a template's words that must agree on one relative position.
COVER = 0.6
#: Words before and behind a template's place in which its key phrase may stand too.
AROUND = 3

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, characters outside words to a blank.
TABLE = bytes((c + 32) if 0x41 <= c <= 0x5A else c if WORD.fullmatch(bytes([c])) else 0x20 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Index:
    """Postings of the templates' words: word -> [(template, place)], and their IDF."""

    def __init__(self, templates=tuple(TEMPLATES), base=None) -> None:
        base = BASE if base is None else base
        self.base = {i: (tuple(p.encode().split()), label) for i, (p, label) in enumerate(base.items())}
        self.templates = {len(self.base) + i: (tuple(t.encode().split()), label, [tuple(p.encode().split()) for p in keys]) for i, (t, label, keys) in enumerate(templates)}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (words, *_) in {**self.base, **self.templates}.items():
            for k, w in enumerate(words):
                self.postings[w].append((i, k))
        self.idf: dict[bytes, float] = {}
        # key phrase -> its templates; template -> word -> places
        self.keys: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        self.inside: dict[int, dict[bytes, list[int]]] = {}
        for i, (words, _, keys) in self.templates.items():
            for phrase in dict.fromkeys(keys):
                self.keys[phrase].append(i)
            self.inside[i] = {w: [k for k, x in enumerate(words) if x == w] for w in words}

    def vocabulary(self) -> frozenset[bytes]:
        return frozenset(self.postings).union(*self.keys)

    def weigh(self, frequencies: dict[bytes, int], n: int) -> None:
        self.idf = {w: log((1 + n) / (1 + frequencies.get(w, 0))) for w in self.vocabulary()}
        # the rarest word of a phrase finds its places
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (words, _) in self.base.items():
            k = self.rarest(words)
            self.anchors[words[k]].append((i, k))
        self.key_anchors: dict[bytes, list[tuple[tuple[bytes, ...], int]]] = defaultdict(list)
        for phrase in self.keys:
            k = self.rarest(phrase)
            self.key_anchors[phrase[k]].append((phrase, k))

    def rarest(self, words: tuple[bytes, ...]) -> int:
        return max(range(len(words)), key=lambda k: (self.idf[words[k]], -k))

    def scan(self, words: list[bytes], present: set[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places with their labels, and the method's labels with the share of the template found."""
        phrases = [(w, phrase, k) for w in present & self.key_anchors.keys() for phrase, k in self.key_anchors[w] if present.issuperset(phrase)]
        anchors = present & self.anchors.keys()
        places: dict[bytes, list[int]] = {w: [] for w in anchors.union(w for w, *_ in phrases)}
        for w in places:
            at = -1
            for _ in range(words.count(w)):
                at = words.index(w, at + 1)
                places[w].append(at)
        base = []
        for w in anchors:
            for i, k in self.anchors[w]:
                phrase, label = self.base[i]
                base += [(p - k, label) for p in places[w] if p >= k and tuple(words[p - k : p - k + len(phrase)]) == phrase]
        found: dict[str, float] = {}
        for w, phrase, k in phrases:
            for p in places[w]:
                if p >= k and tuple(words[p - k : p - k + len(phrase)]) == phrase:
                    for i in self.keys[phrase]:
                        label = self.templates[i][1]
                        if found.get(label, 0) < 1 and (agree := self.cover(i, words, p - k, len(phrase))) >= COVER:
                            found[label] = max(found.get(label, 0), agree)
        return base, found

    def cover(self, i: int, words: list[bytes], start: int, size: int) -> float:
        """The largest share of a template's words that agree on one place in whose reach the key phrase of `size` words at `start` lies."""
        length, inside = len(self.templates[i][0]), self.inside[i]
        first, last = start + size - length - AROUND, start + AROUND
        votes: Counter = Counter()
        for q in range(max(0, first), min(len(words), last + length)):
            for k in inside.get(words[q], ()):
                if first <= q - k <= last:
                    votes[q - k] += 1
        return max(votes.values(), default=0) / length


def license_scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    index = index or Index()
    known = index.vocabulary()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, n = Counter(), 0
        for batch in common.slices(batches):
            for text in common.texts(batch):
                counter.update(known.intersection(words_of(text)))
                n += 1
        rows = [(b"", n), *counter.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "word binary, n long").groupBy("word").sum("n").collect()  # a row for each word of the templates
    counts = {bytes(w): n for w, n in counted}
    index.weigh(counts, counts.pop(b"", 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                words = words_of(text)
                base, found = index.scan(words, present) if (present := known.intersection(words)) else ([], {})
                at = [p for p, _ in base]
                labels = {label for _, label in base}
                rows.append((doc_id, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), max([1.0 if base else 0.0, *found.values()])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can state."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: The base columns and the number of words; labels of the method and the score have no SQL.
BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest([{'phrase': ['mit', 'license'], 'label': 'mit'}, {'phrase': ['apache', 'license'], 'label': 'apache'}, {'phrase': ['general', 'public', 'license'], 'label': 'gpl'}]) AS b FROM w),
f AS (SELECT doc_id, b.label AS label, unnest(list_filter(range(0, len(words)), lambda k: words[k + 1 : k + len(b.phrase)] = b.phrase)) AS place FROM p)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, count(f.place) AS n_base, min(f.place) AS first_word, max(f.place) AS last_word, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS base_labels
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id, w.words"""
