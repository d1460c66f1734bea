"""License scan by patience alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased; other ASCII characters separate them.  A text holds a license where
an alignment with one of its templates covers at least COVERAGE of the template's
words, its key words among them, inside a stretch of at most
``stretch(template)`` words.

Stretches are found first: one that can hold such an alignment has at least as
many words of the template's vocabulary as the alignment would cover, which
running counts over all words of all texts show without any alignment.  Each is
then aligned: common ends are matched, words that occur once in the text's part and
once in the template's are anchors, the longest increasing subsequence of them is
kept, and the gaps between anchors are aligned in the same way.  After a finding
the scan goes on behind it, so repeated notices are found one by one.

No shuffle: each text is scanned whole, where it is read.

Defined cases: null and empty texts hold nothing; repeated rows give repeated
findings; a text of any length is scanned whole, as one slice if it is longer than
one; of overlapping notices of one template the first counts, and notices of several
templates are several findings; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import kernel
from .shared import map_batches

COVERAGE = 0.85


@dataclass(frozen=True)
class Template:
    name: str
    family: str
    key: str  # words without which it is another license
    text: str


#: Notices of public licenses.
TEMPLATES = (
    Template("MIT", "permissive", "mit", "Released under the MIT License."),
    Template(
        "MIT", "permissive", "merchantability",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    Template("Apache-2.0", "permissive", "apache 2", "Licensed under the Apache License, Version 2.0."),
    Template(
        "Apache-2.0", "permissive", "apache 2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "BSD-3-Clause", "permissive", "redistribution endorse",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    Template(
        "ISC", "permissive", "isc",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template("GPL-3.0", "copyleft", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "GPL-3.0", "copyleft", "gnu 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "MPL-2.0", "copyleft", "mozilla 2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    Template("CC-BY-NC-4.0", "noncommercial", "cc nc", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "copyleft", "cc sa", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-4.0", "permissive", "creative attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> kernel.Words:
    return kernel.Words(_FOLD[data], offsets)


def stretch(n_words: int) -> int:
    """Most words of a text that an alignment with a template of n words may span."""
    return n_words + max(4, n_words // 4)


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: pairs (place in text, place in template), increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        anchors = _increasing(_unique_to_both(text[a:b], template[c:d]))
        if not anchors:
            continue
        i, j = a, c
        for x, y in anchors:
            pairs.append((a + x, c + y))
            gaps.append((i, a + x, j, c + y))
            i, j = a + x + 1, c + y + 1
        gaps.append((i, b, j, d))
    return sorted(pairs)


def _unique_to_both(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    where: list[dict[int, int]] = []
    for words in (text, template):
        seen: dict[int, int] = {}
        for i, w in enumerate(words):
            seen[w] = -1 if w in seen else i
        where.append(seen)
    other = where[1]
    return [(i, other[w]) for w, i in where[0].items() if i >= 0 and other.get(w, -1) >= 0]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in both numbers; pairs come in order of the first."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back[k] = at[n - 1] if n else -1
        tails[n : n + 1] = [j]
        at[n : n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates as numbers: a word is its number in the templates' vocabulary, or -1."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE):
        self.templates = templates
        hashes = [self._hashes(t.text) for t in templates]
        self.vocabulary = np.unique(np.concatenate(hashes))
        number = lambda h: np.searchsorted(self.vocabulary, h)
        self.words = [number(h).tolist() for h in hashes]
        self.keys = [set(number(self._hashes(t.key)).tolist()) for t in templates]
        self.least = [int(np.ceil(coverage * len(w))) for w in self.words]
        self.member = np.zeros((len(templates), len(self.vocabulary) + 1), bool)  # the last: no word of any template
        for t, w in enumerate(self.words):
            self.member[t, w] = True

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return words_of(raw, np.array([0, len(raw)])).hashes()

    def numbers(self, words: kernel.Words) -> np.ndarray:
        h = words.hashes()
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == h, i, -1)

    def scan(self, words: kernel.Words) -> list[tuple[int, int, int, int, int]]:
        """(row, template, covered words, first word, end word) of every finding in a slice."""
        number = self.numbers(words)
        if not len(number):
            return []
        row_end = np.repeat(words.word_off[1:], words.counts())
        here = np.arange(len(number))
        found = []
        for t, template in enumerate(self.words):
            total = np.concatenate([[0], np.cumsum(self.member[t][number])])
            end = np.minimum(here + stretch(len(template)), row_end)
            starts = np.flatnonzero((total[end] - total[:-1] >= self.least[t]) & self.member[t][number])
            behind = -1
            for s in starts.tolist():
                if s < behind:
                    continue
                pairs = align(number[s : end[s]].tolist(), template)
                if len(pairs) >= self.least[t] and self.keys[t] <= {template[j] for _, j in pairs}:
                    row = int(np.searchsorted(words.word_off, s, side="right")) - 1
                    behind = s + pairs[-1][0] + 1
                    base = int(words.word_off[row])
                    found.append((row, t, len(pairs), s + pairs[0][0] - base, behind - base))
        return sorted(found)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, family, coverage, first_word, end_word: one row for each notice found."""
    made = StructType(
        [StructField("doc_id", LongType()), StructField("license", StringType()), StructField("family", StringType()), StructField("coverage", DoubleType())]
        + [StructField("first_word", LongType()), StructField("end_word", LongType())]
    )
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = kernel.text_buffer(batch.column(1))
            for a, b in kernel.row_slices(offsets):
                found = scanner.scan(words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if found:
                    row, t, n, first, end = (np.array(c) for c in zip(*found))
                    share = n / np.array([len(w) for w in scanner.words])[t]
                    names = [[getattr(templates[i], f) for i in t] for f in ("name", "family")]
                    columns = [ids.take(pa.array(a + row)), *(pa.array(c, pa.string()) for c in names), pa.array(share), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=made.fieldNames())

    return source.transform(map_batches, run, made)
