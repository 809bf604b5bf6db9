"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Templates fall into length classes (BASE words, twice that, and so on). For each
class the words of a text are covered by windows of twice the class's length
that overlap by half, so that any stretch no longer than the class lies wholly
in one of them. Window and template then share at least `containment` of the
template's shingles, which makes their Jaccard similarity at least
containment / (2 * growth + 1) (see `least_similarity`); there are as many
one-row bands as find such a pair with a probability of 1 - MISS. Whatever a
band retrieves is verified: the share of the template's distinct five-word
shingles that the window holds.

Templates are a parameter of bounded size (thousands of notices), known to every
task; texts of any length are read once and nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import map_arrow
from sensorlab.llm.words import distinct_sorted, hash_words, mix64, plain_words, shingle_hashes, split_words

SIZE = 5
BASE = 8
MISS = 1e-4

# Wordings of public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:"
    ),
}


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, their ends, and the number of words of each text."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    known = hash_words(plain_words(coded.dictionary))
    hashes = known[coded.indices.to_numpy()] if len(words) else known
    return *shingle_hashes(hashes, ends, SIZE), np.diff(ends, prepend=0)


def least_similarity(containment: float, length: int, shortest: int) -> float:
    """Least Jaccard similarity of a template of `shortest` shingles and a window of a class that holds `containment` of it."""
    return containment * shortest / (2 * length + (1 - containment) * shortest)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


class Templates:
    """Band keys and shingle sets of the templates, by length class."""

    def __init__(self, notices: dict[str, str], containment: float) -> None:
        self.names = sorted(n for n, text in notices.items() if (text or "").split())
        values, ends, words = _shingles(pa.array([notices[n] for n in self.names], pa.string()))
        sets, ends = distinct_sorted(values, ends)
        starts = np.concatenate([[0], ends])[:-1]
        self.sets = [sets[a:b] for a, b in zip(starts, ends, strict=True)]
        self.words, self.containment = words, containment
        self.classes = []
        length_of = BASE * 2 ** np.ceil(np.log2(np.maximum(words, 1) / BASE)).clip(0).astype(int)
        for length in sorted(set(length_of.tolist())):
            own = np.flatnonzero(length_of == length)
            bands = bands_for(least_similarity(containment, length, min(len(self.sets[t]) for t in own)))
            keys = np.array([[minimum(self.sets[t], k) for t in own] for k in range(bands)])
            self.classes.append((length, own, keys))


def coordinate(values: np.ndarray, k: int) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32) ^ np.uint32(mix64(np.array([k + 1], np.uint64))[0] & np.uint64(0xFFFFFFFF))
    x *= np.uint32(0x85EBCA6B)  # fixed values: odd multipliers of a common 32-bit finaliser
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(13))


def minimum(values: np.ndarray, k: int) -> int:
    return int(coordinate(values, k).min())


def find_notices(values: np.ndarray, ends: np.ndarray, words: np.ndarray, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """Text, template, start, words and containment of the best window for each text and template."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    first = np.concatenate([[0], ends])[:-1].astype(np.int64)
    size = ends - first
    for length, own, keys in templates.classes:
        # Halves of `length` shingles; a window is a half and the next one of the same text.
        halves = -(-size // length)
        text = np.repeat(np.arange(len(size)), halves)
        at = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves)
        start = first[text] + at * length
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.empty(0, bool)
        found = set()
        for k in range(len(keys)):
            if not len(start):
                break
            least = np.minimum.reduceat(coordinate(values, k), start)
            window = np.where(last, least, np.minimum(least, np.append(least[1:], 0)))
            for j, key in enumerate(keys[k].tolist()):
                found.update((int(w), int(own[j])) for w in np.flatnonzero(window == np.uint32(key)))
        for w, t in sorted(found):
            a, b = start[w], min(start[w] + 2 * length, ends[text[w]])
            places = np.flatnonzero(np.isin(values[a:b], templates.sets[t]))
            share = len(np.unique(values[a:b][places])) / len(templates.sets[t])
            if share >= templates.containment:
                begin = int(a + places[0] - first[text[w]])
                n = min(int(places[-1] - places[0]) + SIZE, int(words[text[w]]))
                key = (int(text[w]), t)
                if key not in best or (share, -begin) > (best[key][0], -best[key][1]):
                    best[key] = (share, begin, n)
    return [(i, t, begin, n, share) for (i, t), (share, begin, n) in sorted(best.items())]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, containment: float = 0.8
) -> DataFrame:
    """One row for each document and notice found in it: ``id_col, license, start, n_words, containment``.

    `start` and `n_words` tell where in the document's words; of several places
    the one with the largest containment, then the first, is given. Words are
    compared in lower case and without punctuation at their ends. Null and empty
    texts hold no notice; repeated rows and rows with a null id give rows each.
    """
    templates = Templates(NOTICES if notices is None else notices, containment)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_notices(*_shingles(batch.column("_text")), templates) if templates.names else []
        i, t, start, n, share = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [], [])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id").take(pa.array(i, pa.int64())), pa.array([templates.names[k] for k in t], pa.string()),
                pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64()),
            ],
            [id_col, "license", "start", "n_words", "containment"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(texts, scan, f"`{id_col}` long, license string, start long, n_words long, containment double")
