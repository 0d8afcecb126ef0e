"""Licence scan with a positional index of rare licence words.

Each template is a licence notice. The index holds, for every template word, its postings (template,
position). The inverse document frequency of template words comes from all documents. A file's licence
words are looked up from the rarest on, until every template that can still match (the file holds the words
of its mandatory phrases) has its anchors: the rarest of its words that the file holds. An anchor at file
position p and template position q votes for the start p - q; the votes of a template are intersected by
that relative position, and a start is dropped when the weight of the anchors that did not vote for it (and of
words that the file lacks) leaves less than ``needed``. This loses no match. At the other starts the template
is matched word by word, with a small slack for inserted words; the score is the matched share of the
template's inverse document frequency. A template counts when its score reaches ``needed`` and its mandatory key
phrases stand within the matched stretch.

Rows: one output row per input row. A null, empty or wordless text has no words, no labels and score
0. A very long text is one array of words in its task. Repeated rows are reported once each; an empty table gives
an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import map_rows

#: Key phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: (label, notice, mandatory phrases). A notice is what a file header or the licence text says. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl-2.0", "this program is free software licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions of the software",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed on an as is basis",)),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
ANCHORS = 3  # rarest words of a template that a file holds
SLACK = 3  # words by which a match may drift from its relative position
NEEDED = 0.8

#: 0-9, a-z and everything beyond ASCII are word characters; A-Z is lower-cased, the rest cuts.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Index:
    """Postings (template, position) of every template word, with weights; fixed in size."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, anchors: int = ANCHORS):
        self.idf, self.anchors = idf, anchors
        self.labels = [label for label, _, _ in templates]
        self.notices = [[w.encode() for w in notice.split()] for _, notice, _ in templates]
        self.must = [[[w.encode() for w in p.split()] for p in must] for _, _, must in templates]
        self.totals = [sum(idf[w] for w in notice) for notice in self.notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for q, w in enumerate(notice):
                self.postings.setdefault(w, []).append((k, q))
        self.rarest = sorted(self.postings, key=lambda w: (-idf[w], w))
        self.needs = [{w for p in must for w in p} for must in self.must]  # words of the mandatory phrases


def vocabulary(templates=TEMPLATES) -> set[bytes]:
    return {w.encode() for _, notice, _ in templates for w in notice.split()}


def document_frequency(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and of rows that hold each template word, over all rows. The result has one
    entry per template word at most, so it is read by the driver."""
    wanted = vocabulary(templates)
    hits = map_rows(
        docs.select(F.col(text_col).cast("string")),
        lambda row: ((w.decode(),) for w in [*wanted.intersection(words_of(row[0])), b""]),
        "word string",
    )
    found = {r["word"].encode(): r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop(b"", 0), found


def build_index(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> Index:
    n, df = document_frequency(docs, text_col, templates)
    return Index({w: math.log((n + 1) / (df.get(w, 0) + 0.5)) + 1 for w in vocabulary(templates)}, templates)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    if b"license" not in words:
        return []
    found, at = [], -1
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES]
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(found)
        for phrase, label in phrases:  # every phrase ends in this word
            a = at + 1 - len(phrase)
            if a >= 0 and words[a : at + 1] == phrase:
                found.append((a, label))


def _holds(words: list[bytes], phrase: list[bytes], lo: int, hi: int) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(lo, hi - len(phrase) + 1))


def share(index: Index, k: int, start: int, places: dict[bytes, list[int]]) -> float:
    """Matched share of template ``k`` at a start: a word counts when it stands within the slack of its place."""
    found = 0.0
    for q, w in enumerate(index.notices[k]):
        own = places.get(w, ())
        i = bisect_left(own, start + q - SLACK)
        if i < len(own) and own[i] <= start + q + SLACK:
            found += index.idf[w]
    return found / index.totals[k]


def votes(index: Index, places: dict[bytes, list[int]]) -> dict[int, dict[bytes, list[int]]]:
    """Per template that the file can match: the starts that each of its anchors votes for, rising."""
    possible = {k for k, need in enumerate(index.needs) if all(w in places for w in need)}
    found: dict[int, dict[bytes, list[int]]] = {k: {} for k in possible}
    for w in index.rarest:
        if not possible:
            break
        if w not in places:
            continue
        for k, q in index.postings[w]:
            if k in possible:
                found[k].setdefault(w, []).extend(p - q for p in places[w])
        possible = {k for k in possible if len(found[k]) < index.anchors}
    return {k: {w: sorted(set(at)) for w, at in by.items()} for k, by in found.items()}


def candidates(index: Index, k: int, by: dict[bytes, list[int]], held: dict[bytes, list[int]], needed: float) -> list[int]:
    """Starts of template ``k`` that can reach ``needed`` by the anchors that agree on them."""
    lacking = sum(index.idf[w] for w in index.notices[k] if w not in held)
    weight = {w: index.idf[w] * index.notices[k].count(w) for w in by}
    kept = []
    for start in sorted({s for at in by.values() for s in at}):
        lost = lacking
        for w, at in by.items():
            i = bisect_left(at, start - SLACK)
            if i == len(at) or at[i] > start + SLACK:
                lost += weight[w]
        if 1 - lost / index.totals[k] >= needed - 1e-9:
            kept.append(start)
    return kept


def matches(words: list[bytes], index: Index, needed: float = NEEDED) -> list[tuple[str, float, int, int]]:
    """``(label, score, start, end)`` of every accepted template match, in word positions."""
    return _matches(words, _places(words, index), index, needed)


def _places(words: list[bytes], index: Index) -> dict[bytes, list[int]]:
    held = index.postings.keys() & set(words)
    places: dict[bytes, list[int]] = {w: [] for w in held}
    for i, w in enumerate(words if held else ()):
        if w in places:
            places[w].append(i)
    return places


def _matches(words, places, index: Index, needed: float):
    found = {}
    for k, by in votes(index, places).items():
        for start in candidates(index, k, by, places, needed):
            score = share(index, k, start, places)
            lo, hi = max(0, start - SLACK), min(len(words), start + len(index.notices[k]) + SLACK)
            if score >= needed and all(_holds(words, p, lo, hi) for p in index.must[k]):
                key = (index.labels[k], max(0, start))
                found[key] = max(found.get(key, (0.0, 0)), (round(score, 6), hi))
    return [(label, s, a, b) for (label, a), (s, b) in sorted(found.items())]


def phrase_score(words: list[bytes], at: list[tuple[int, str]], places, index: Index) -> float:
    """Best share of a template around a phrase's places: what a phrase without its notice is worth."""
    best = 0.0
    for phrase, label in PHRASES:
        rare = max((w.encode() for w in phrase.split()), key=lambda w: index.idf.get(w, 0.0))
        for q0, k in [(q, k) for k, q in index.postings.get(rare, ())]:
            inside = phrase.encode().split().index(rare)
            best = max([best, *(share(index, k, a + inside - q0, places) for a, x in at if x == label)])
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """One row per row: number of words, phrase places, template matches and the score."""
    index = index or build_index(docs, text_col)

    def one(row):
        words = words_of(row[1])
        places, at = _places(words, index), phrase_places(words)
        found = _matches(words, places, index, NEEDED)
        best = max((score for _, score, _, _ in found), default=None)
        yield row[0], len(words), at, found, phrase_score(words, at, places, index) if best is None else best

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        one,
        f"id {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, "
        "matches array<struct<label:string,score:double,start:bigint,end:bigint>>, score double",
    ).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scan as one flat row per document; score is that of the best match, without one the best share of a
    template around a phrase's places."""
    base, starts = F.col("places.label"), F.col("places.start")

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("matches.label"))).alias("labels"),
        F.least("score", F.lit(1.0)).alias("score"),
    )
