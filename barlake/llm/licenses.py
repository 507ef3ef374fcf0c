"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates and texts are words (A-Z lower-cased, ASCII digits, letters and all
non-ASCII characters) in five-word shingles.  Templates are grouped by size:
class W holds those of W/2 < n <= W shingles.  A text is cut into blocks of W/4
shingles and a window is five consecutive blocks, so any stretch of W shingles
lies inside a window.

Each shingle is hashed once; the low bits name one of ``BINS`` bins, and the
least hash of a bin is a MinHash value and a band of its own.  A template of
which three quarters occur in a window has a Jaccard similarity of at least 0.27
with it.  Templates of more than ``BINS`` shingles fill 50 bins or more of the
union, each of which collides with that probability, so one is missed with
probability 0.73^50 < 2e-7.  Smaller templates would leave bins empty; for them
every shingle is a value of its own (a bin for each), so that none is missed.
Block minima of one class are merged to those of the next.

A retrieved pair counts if the window holds at least ``CONTAINMENT`` of the
template's distinct shingles.  Templates of fewer than five words are one
shingle of their own length.

Null or word-less text has no matches; null or word-less templates match
nothing.  Repeated rows are judged alike, rows without id too; of templates with
one id each counts.  Time is linear in the text, whatever it repeats.  Further
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alnum_table, grams, mix, row_slices, text_buffer, words_of

K = 5
BINS = 64
CONTAINMENT = 0.75
#: Templates travel with the task; more than this many words of them are refused.
MOST_WORDS = 2_000_000
_MAX = np.uint32(0xFFFFFFFF)

# Notices of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "lgpl-3.0-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
        "any purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _minima(shingles: np.ndarray, stretch: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (one row a bin) of ``n`` stretches, given each shingle's stretch."""
    h = mix(shingles)
    out = np.full((BINS, n), _MAX, np.uint32)
    np.minimum.at(out.ravel(), (h & np.uint64(BINS - 1)).astype(np.int64) * n + stretch, (h >> np.uint64(33)).astype(np.uint32))
    return out


class Templates:
    """Templates by class, with the values that retrieve them."""

    def __init__(self, named: list[tuple[str, str]]):
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.classes: dict[int, list[int]] = {}
        for name, text in named:
            data, offsets = text_buffer(pa.array([text], pa.string()))
            h = words_of(data, offsets, alnum_table()).hashes
            if not len(h):
                continue
            t = len(self.names)
            self.names.append(str(name))
            if len(h) < K:
                self.short.setdefault(len(h), []).append((int(grams(h, len(h))[0]), t))
                self.sets.append(grams(h, len(h)))
                continue
            self.sets.append(np.unique(grams(h, K)))
            self.classes.setdefault(max(4, 1 << (len(h) - K).bit_length()), []).append(t)
        self.values = {}
        for size, members in self.classes.items():
            if size <= BINS:  # every shingle: sorted, and whose it is
                flat, owner = np.concatenate([self.sets[t] for t in members]), np.repeat(np.arange(len(members)), [len(self.sets[t]) for t in members])
                order = np.argsort(flat, kind="stable")
                self.values[size] = flat[order], owner[order]
            else:
                self.values[size] = np.concatenate([_minima(self.sets[t], np.zeros(len(self.sets[t]), np.int64), 1) for t in members], axis=1)

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per row: (template, first word, end word, containment)."""
        n_rows = len(offsets) - 1
        out: list[list] = [[] for _ in range(n_rows)]
        row = np.repeat(np.arange(n_rows), np.diff(offsets))
        for n, listed in self.short.items():
            g = grams(hashes, n)
            wanted = np.array([x for x, _ in listed], np.uint64)
            for p in np.flatnonzero((row[: len(g)] == row[n - 1 :][: len(g)]) & np.isin(g, wanted)).tolist():
                r = int(row[p])
                out[r] += [(t, p - int(offsets[r]), p - int(offsets[r]) + n, 1.0) for x, t in listed if x == int(g[p])]
        long = np.flatnonzero(np.diff(offsets) >= K)
        if self.classes and len(long):
            counts = np.diff(offsets)[long] - K + 1
            first = np.cumsum(counts) - counts  # of each long row among the shingles inside rows
            at = np.repeat(offsets[long] - first, counts) + np.arange(int(counts.sum()))
            self._long_matches(grams(hashes, K)[at], first, counts, long, out)
        return [_distinct(x) for x in out]

    def _long_matches(self, shingles: np.ndarray, first: np.ndarray, counts: np.ndarray, long: np.ndarray, out: list) -> None:
        owner = np.repeat(np.arange(len(counts)), counts)
        for size in [x for x in self.classes if x <= BINS]:
            for t, r, b in self._sharing(size, shingles, owner, first, counts):
                self._verify(t, r, b, size // 4, shingles, first, counts, long, out)
        if max(self.classes) <= BINS:
            return
        size = min(x for x in self.classes if x > BINS)
        block = size // 4
        n_blocks = -(-counts // block)
        begin = np.cumsum(n_blocks) - n_blocks
        minima = _minima(shingles, begin[owner] + (np.arange(len(owner)) - first[owner]) // block, int(n_blocks.sum()))
        while True:
            if size in self.classes:
                for k, b in self._colliding(size, minima, n_blocks):
                    r = int(np.searchsorted(begin, b, side="right")) - 1
                    self._verify(self.classes[size][k], r, b - int(begin[r]), block, shingles, first, counts, long, out)
            if size >= max(self.classes):
                break
            halves = -(-n_blocks // 2)
            heads = np.cumsum(halves) - halves
            pairs = np.repeat(begin, halves) + 2 * (np.arange(int(halves.sum())) - np.repeat(heads, halves))
            minima = np.minimum.reduceat(minima, pairs, axis=1)
            n_blocks, begin, block, size = halves, heads, block * 2, size * 2

    def _sharing(self, size: int, shingles: np.ndarray, owner: np.ndarray, first: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, row, window) of all windows that share a shingle with a small template."""
        values, whose = self.values[size]
        low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
        at = np.flatnonzero(low < high)
        n = (high - low)[at]
        p = np.repeat(at, n)
        k = whose[np.repeat(low[at] - (np.cumsum(n) - n), n) + np.arange(len(p))]
        r = owner[p]
        block = (p - first[r]) // (size // 4)
        found = np.unique(np.concatenate([np.stack((k, r, block - j))[:, block >= j] for j in range(5)], axis=1), axis=1)
        return [(self.classes[size][k], r, b) for k, r, b in found.T.tolist()]

    def _colliding(self, size: int, minima: np.ndarray, n_blocks: np.ndarray) -> list[tuple[int, int]]:
        """(member of the class, window) whose bands collide."""
        owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
        window = minima.copy()
        for j in range(1, 5):
            if j < len(owner):
                near = np.where(owner[j:] == owner[:-j], minima[:, j:], _MAX)
                np.minimum(window[:, :-j], near, out=window[:, :-j])
        found = []
        for k, value in enumerate(self.values[size].T):
            same = (window == value[:, None]) & (value[:, None] != _MAX)
            found += [(k, b) for b in np.flatnonzero(same.any(axis=0)).tolist()]
        return found

    def _verify(self, t: int, r: int, b: int, block: int, shingles: np.ndarray, first: np.ndarray, counts: np.ndarray, long: np.ndarray, out: list) -> None:
        """Adds the match of a template in window ``b`` of a row, if enough of it is there."""
        x = int(first[r]) + block * b
        y = min(x + 5 * block, int(first[r] + counts[r]))
        hit = np.isin(shingles[x:y], self.sets[t])
        share = len(np.unique(shingles[x:y][hit])) / len(self.sets[t])
        if share >= CONTAINMENT:
            places = np.flatnonzero(hit) + x - int(first[r])
            out[int(long[r])].append((t, int(places[0]), int(places[-1]) + K, share))


def _distinct(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of overlapping matches of one template the fullest and then shortest stays."""
    kept: dict[int, list[tuple[int, int, float]]] = {}
    for t, a, b, share in sorted(set(found), key=lambda x: (x[0], -x[3], x[2] - x[1], x[1])):
        own = kept.setdefault(t, [])  # disjoint and in order, so that only neighbours can overlap
        i = bisect_left(own, (a,))
        if not (i < len(own) and own[i][0] < b) and not (i and own[i - 1][1] > a):
            own.insert(i, (a, b, share))
    return sorted(((t, *x) for t, own in kept.items() for x in own), key=lambda x: (x[1], x[2], x[0]))


MATCH = "array<struct<template_id:string,start:int,end:int,containment:double>>"
_MATCH = pa.list_(pa.struct([("template_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, matches) for every row of ``docs`` (doc_id, text); spans count words."""
    named = list(TEMPLATES.items()) if templates is None else [(a, b) for a, b in templates if b]
    if sum(len(b.split()) for _, b in named) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    index = Templates(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets, 1 << 18):
                w = words_of(data, offsets[a : b + 1], alnum_table())
                found = [[{"template_id": index.names[t], "start": s, "end": e, "containment": c} for t, s, e, c in x] for x in index.matches(w.hashes, w.offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.offsets), pa.int64()), pa.array(found, _MATCH)], ["doc_id", "n_words", "matches"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, n_words long, matches {MATCH}")
