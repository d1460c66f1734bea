"""Byte tries of terms with counters at the leaves, as flat arrays.

A radix trie is kept in the order in which it is traversed: leaf i is told by the
number of bytes it shares with leaf i - 1 (the depth of the node where their paths
part) and by the bytes of its own edge.  Bytes in order are code points in order, so
a traversal gives the terms in the order of UTF-8.  Two tries are merged by one pass
over their leaves, a subtree or range of prefixes is an interval of leaves, and all
of it is numpy and Arrow over whole arrays.

Each leaf has counters for the groups in which its term occurs: entries
(leaf, group, occurrences, documents) ordered by leaf and group.
"""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernel import row_slices, text_buffer

#: Bytes of terms: letters A-Z and a-z and all bytes of code points over U+007F.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def slice_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms of a slice of rows, row of each term)."""
    solid = _TERM[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    return binary(np.concatenate([[0], np.cumsum(sizes)]), _LOWER[data[solid]]), np.searchsorted(offsets, starts, side="right") - 1


class Trie:
    """A trie that grows by leaves; ``leaves`` is its size, ``weight`` its bytes of terms."""

    def __init__(self):
        self._parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._merged = 0  # parts that are one trie already
        self.entries = self.weight = 0

    def add(self, terms: pa.Array, leaf: np.ndarray, group: np.ndarray, occurrences: np.ndarray, documents: np.ndarray) -> None:
        """Entries of ``terms`` (distinct, in any order); merged when the new ones are as many as the old."""
        self._parts.append((terms, leaf, group, occurrences, documents))
        self.entries += len(leaf)
        self.weight += terms.nbytes
        if self.entries > 2 * max(self._merged, 1 << 16):
            self.merge()

    def merge(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms in order, leaf, group, occurrences, documents): one trie of all that was added."""
        if not self._parts:
            none = np.zeros(0, np.int64)
            return binary(np.zeros(1, np.int64), np.zeros(0, np.uint8)), none, none, none, none
        terms, numbers = ordered(pa.concat_arrays([p[0] for p in self._parts]))
        base = np.cumsum([0] + [len(p[0]) for p in self._parts])
        leaf = np.concatenate([numbers[p[1] + b] for p, b in zip(self._parts, base)])
        group, occurrences, documents = (np.concatenate([p[i] for p in self._parts]) for i in (2, 3, 4))
        width = int(group.max(initial=0)) + 1
        keys = leaf * width + group
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, sums = keys[at], [np.add.reduceat(counts[order], at) for counts in (occurrences, documents)]
        one = (terms, keys // width, keys % width, *sums)
        self._parts, self._merged, self.entries, self.weight = [one], len(keys), len(keys), terms.nbytes
        return one

    def add_rows(self, column: pa.Array, group: np.ndarray) -> None:
        """Counts the terms of a text column; group: a number for each row."""
        data, offsets = text_buffer(column)
        for a, b in row_slices(offsets):
            terms, row = slice_terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            by_group = np.argsort(group[a:b], kind="stable")  # rows of a group are neighbours in this order
            place = np.empty(b - a, np.int64)
            place[by_group] = np.arange(b - a)
            key = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (b - a) + place[row])
            new_row = np.ones(len(key), bool)
            new_row[1:] = key[1:] != key[:-1]
            leaf, own = key // (b - a), group[a:b][by_group][key % (b - a)]
            first = np.ones(len(key), bool)
            first[1:] = (leaf[1:] != leaf[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(first)
            self.add(coded.dictionary, leaf[at], own[at], np.diff(np.append(at, len(key))), np.add.reduceat(new_row.astype(np.int64), at))


def ordered(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct terms in byte order, number of each given term among them)."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), number[coded.indices.to_numpy(zero_copy_only=False)]


def flatten(terms: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(bytes shared with the leaf before, bytes of the own edge) of distinct terms in byte order."""
    shared, edges, last = [], [], b""
    for term in terms:
        n = len(os.path.commonprefix([last, term]))
        shared.append(n)
        edges.append(term[n:])
        last = term
    return shared, edges


def traverse(shared: list[int], edges: list[bytes]) -> list[bytes]:
    """The terms of a flat trie, in byte order."""
    out, last = [], b""
    for n, edge in zip(shared, edges):
        last = last[:n] + edge
        out.append(last)
    return out
