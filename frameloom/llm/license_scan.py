"""Licence scans with a positional rare-token index.

Templates of licence notices are indexed by word: postings (template, positions), with the IDF of every word
(document frequencies are counted over all documents). A file's licence words are looked up from the highest IDF down,
and each template that they lead to takes the first few; where these, taken from their postings, agree on the relative
position of file and template, that is an alignment; it is a match only if the mandatory key phrase stands where the
alignment puts it. Words that a file lacks take no part, however rare. Plain phrases with labels of their own (``base``)
are found at every place they stand.

Words: A-Z is lower-cased, words are runs of letters a-z, digits and all code points from U+0080.

Defined results: null or empty text has no words, no labels, score 0; null ids and repeated rows are
kept; an empty table gives an empty table; ties of labels are joined in code-point order. Only the id
and the text are read. The score is the largest share of a matched template's words that stand at
their aligned places, 1 where a base phrase stands.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licences as (label, notice, mandatory key phrase that stands in it).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl-2.1", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "either version 2 1 of the license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0 1 0 universal", "cc0 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("eupl-1.2", "licensed under the european union public licence version 1 2", "european union public licence"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class LicenseIndex:
    """Postings of the templates' words in order of IDF."""

    templates: list[tuple[str, str, str]] = field(default_factory=lambda: list(TEMPLATES))
    base: dict[str, str] = field(default_factory=lambda: dict(BASE_PHRASES))
    rare_words: int = 4  # that a file shares with a template, of the highest IDF
    least_votes: int = 2

    def __post_init__(self):
        self.words = [words_of(t) for _, t, _ in self.templates]
        self.phrases = [(words_of(p), label) for p, label in self.base.items()]
        self.keys = []
        for (_, _, phrase), ws in zip(self.templates, self.words, strict=True):
            key = words_of(phrase)
            at = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
            self.keys.append((key, at))
        #: word: the templates that have it, and where
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            places: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(ws):
                places[w].append(i)
            for w, at in places.items():
                self.postings[w].append((k, at))
        self.vocabulary = self.postings.keys() | {w for ws, _ in self.phrases for w in ws}
        self.weigh({})

    def weigh(self, idf: dict[bytes, float]) -> None:
        """Ranks the templates' words by IDF, rarest first; ties and words that no document has by the words themselves."""
        self.rank = {w: r for r, w in enumerate(sorted(self.postings, key=lambda w: (-idf.get(w, math.inf), w)))}

    def candidates(self, found: set[bytes]) -> dict[int, list[tuple[bytes, list[int]]]]:
        """Of each template that the file's licence words lead to, its rarest of them with their places in the template."""
        out: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for w in sorted(found & self.rank.keys(), key=self.rank.__getitem__):
            for k, at in self.postings[w]:
                if len(out[k]) < self.rare_words:
                    out[k].append((w, at))
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        found = self.vocabulary.intersection(words)
        spots, base = [], set()
        places: dict[bytes, list[int]] = {}

        def at(word: bytes) -> list[int]:
            if word not in places:
                out, i = [], -1
                for _ in range(words.count(word)):
                    i = words.index(word, i + 1)
                    out.append(i)
                places[word] = out
            return places[word]

        for phrase, label in self.phrases:
            if found.issuperset(phrase):
                rarest = min(range(len(phrase)), key=lambda i: len(at(phrase[i])))
                here = [p - rarest for p in at(phrase[rarest]) if p >= rarest and words[p - rarest : p - rarest + len(phrase)] == phrase]
                spots += here
                base |= {label} if here else set()
        labels, score, matches = set(base), 1.0 if base else 0.0, []
        for k, rare in self.candidates(found).items():
            if len(rare) < self.least_votes or not found.issuperset(self.keys[k][0]):  # the phrase cannot stand anywhere
                continue
            votes: Counter = Counter()
            for w, there in rare:
                votes.update(p - i for p in at(w) for i in there)
            key, i = self.keys[k]
            template = self.words[k]
            for offset, n in votes.items():
                if n < self.least_votes or offset + i < 0 or words[offset + i : offset + i + len(key)] != key:
                    continue
                share = sum(offset + j >= 0 and words[offset + j : offset + j + 1] == [w] for j, w in enumerate(template)) / len(template)
                labels.add(self.templates[k][0])
                score = max(score, share)
                matches.append((self.templates[k][0], offset, share))
        return {"n_words": len(words), "n_base": len(spots), "first_word": min(spots, default=None), "last_word": max(spots, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "matches": [dict(zip(("label", "word", "share"), m, strict=True)) for m in sorted(matches)]}


def fit_license_index(docs: DataFrame, text_col: str = "text", **options) -> LicenseIndex:
    """An index with the IDF of every licence word over all documents; the driver gets a row per licence word."""
    index = LicenseIndex(**options)
    vocabulary = index.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w.decode() for w in seen)], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    total = n.pop(None, 0)
    index.weigh({w.encode(): math.log((1 + total) / (1 + k)) for w, k in n.items()})
    return index


def scan_licenses(docs: DataFrame, index: LicenseIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every whole text."""
    long, string = pa.int64(), pa.string()
    kinds = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": string, "labels": string, "score": pa.float64(), "matches": pa.list_(pa.struct([("label", string), ("word", long), ("share", pa.float64())]))}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[c] for f in found], k) for c, k in kinds.items()]], [id_col, *kinds])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:bigint,share:double>>")
