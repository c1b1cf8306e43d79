"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, lower-cased. Each template's ``GRAM``-word shingles are hashed and
winnowed (the least hash of each ``WINDOW`` in a row); an inverted index of these fingerprints is held by
every worker. A text's shingles are winnowed in the same way, so a shared run of GRAM + WINDOW - 1 words
always shares a fingerprint. Hits of one template on nearby diagonals are a candidate place; there the
template is aligned to the text within a band, and the share of its words that match, in order, is its
coverage; the words that the best place leaves on either side are aligned again, so copies side by side are
found one by one. Places that overlap are one, the best.

Defined cases: null and empty texts match nothing; a template of fewer than GRAM words is one shingle;
repeated passages are reported each; templates that cover the same words are all reported; repeated rows
are scanned alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .near_dedup import WordHashes
from .words import gram_hashes as _grams

GRAM, WINDOW, BAND = 3, 2, 8
#: Least share of a template's words that must match.
COVERAGE = 0.8

#: Notices as their licenses word them.
TEMPLATES = {
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCHES = "array<struct<license string, coverage double, matched int, start int, end int>>"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """Positions that winnowing keeps: the last least of each window."""
    if len(grams) <= 1:
        return np.arange(len(grams))
    w = min(WINDOW, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(n for n in templates if words_of(templates[n]))
        self.words = [words_of(templates[n]) for n in self.names]
        self.own = [set(w) for w in self.words]
        hashes = WordHashes()
        places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            grams = _grams(_hashed(words, hashes), min(GRAM, len(words)))
            for p in fingerprints(grams).tolist():
                places.setdefault(int(grams[p]), []).append((t, p))
        order = sorted(places)
        self.prints = np.asarray(order, np.uint64)
        self.places = [places[x] for x in order]
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        #: Sizes with a template of one shingle, shorter than what winnowing is sure to see: there every shingle of a text counts.
        self.every = {min(GRAM, len(w)) for w in self.words if len(w) <= GRAM}


def align(template: list[bytes], words: list[bytes], diagonal: int, band: int = BAND, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """(matched words, start, end): the longest in-order match of ``template`` with words[low:high] near ``diagonal``; of equals the tightest, then the first.

    Cell (i, j) pairs template word i with text word i + diagonal + j - band; only 2 * band + 1 cells a row exist.
    A cell holds the most words matched so far and, of equals, the latest start.
    """
    width = 2 * band + 1
    high = len(words) if high is None else min(high, len(words))
    none = (0, -1)
    previous = [none] * width
    found = (0, -1, -1)
    for i, word in enumerate(template):
        row = [none] * width
        for j in range(width):
            at = i + diagonal + j - band
            best = previous[j]
            if j + 1 < width and previous[j + 1] > best:  # template word skipped
                best = previous[j + 1]
            if j and row[j - 1] > best:  # text word skipped
                best = row[j - 1]
            if low <= at < high and words[at] == word:
                n, start = previous[j]
                best = max(best, (n + 1, start if n else at))
                own = (n + 1, start if n else at, at + 1)
                if (own[0], own[1] - own[2], -own[1]) > (found[0], found[1] - found[2], -found[1]):
                    found = own
            row[j] = best
        previous = row
    return found


def places(template: list[bytes], own: set[bytes], words: list[bytes], diagonal: int, least: float) -> Iterator[tuple[int, int, int]]:
    """Every place in the band around ``diagonal``: the best one, then those in the words left on either side of it."""
    left = [(max(0, diagonal - BAND), min(len(words), diagonal + len(template) + BAND))]
    while left:
        low, high = left.pop()
        if sum(w in own for w in words[low:high]) < least * len(template):
            continue
        matched, start, end = align(template, words, diagonal, BAND, low, high)
        if matched and matched >= least * len(template):
            yield matched, start, end
            left += [(low, start), (end, high)]


def scan(text: str | None, index: Index, hashes: WordHashes, least: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched, start, end) of each match, in words, in the text's order."""
    words = words_of(text)
    if not words or not len(index.prints):
        return []
    h = _hashed(words, hashes)
    hits: set[tuple[int, int]] = set()
    for n in index.sizes:
        grams = _grams(h, n)
        if not len(grams):
            continue
        kept = np.arange(len(grams)) if n in index.every else fingerprints(grams)
        at = np.minimum(np.searchsorted(index.prints, grams[kept]), len(index.prints) - 1)
        for k in np.flatnonzero(index.prints[at] == grams[kept]).tolist():
            hits |= {(t, int(kept[k]) - p) for t, p in index.places[at[k]]}
    found: list[tuple[str, float, int, int, int]] = []
    last: tuple[int, int] | None = None
    for t, diagonal in sorted(hits):
        if last is not None and last[0] == t and diagonal - last[1] <= BAND // 2:
            continue  # inside the band of the place before
        last = (t, diagonal)
        for matched, start, end in places(index.words[t], index.own[t], words, diagonal, least):
            found.append((index.names[t], matched / len(index.words[t]), matched, start, end))
    best: list[tuple[str, float, int, int, int]] = []
    taken: dict[str, list[tuple[int, int]]] = {}
    for m in sorted(set(found), key=lambda m: (-m[2], m[4] - m[3], m[3], m[0])):
        spans = taken.setdefault(m[0], [])
        k = bisect_left(spans, (m[4], -1))  # spans before k start before this one ends
        if not k or spans[k - 1][1] <= m[3]:
            spans.insert(k, (m[3], m[4]))
            best.append(m)
    return sorted(best, key=lambda m: (m[3], m[4], m[0]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id and matches, an array of (license, coverage, matched, start, end)."""
    spark = docs.sparkSession
    small_batches(spark)
    index = Index(TEMPLATES if templates is None else templates)
    shared = spark.sparkContext.broadcast(index)  # as large as the templates

    @F.pandas_udf(MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "coverage", "matched", "start", "end"), m, strict=True)) for m in scan(t if isinstance(t, str) else None, shared.value, hashes)] for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("matches"))
