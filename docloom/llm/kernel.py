"""Word arithmetic on Arrow batches, shared by the operators of this subpackage.

A text column arrives as one Arrow buffer; words, word hashes and hashes of
word windows are computed over that buffer with numpy, without making a Python
object for each word.  Batches are cut into slices of whole rows of about
``SLICE_BYTES`` so that memory stays bounded whatever the batch holds (one row
longer than the slice is a slice of its own).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is
the pattern ``[^\\x20\\x09-\\x0D]+``.  A null text has no words, like an empty one.

Hashes are 64-bit polynomials over the bytes (mod 2**64) followed by a
finaliser.  They select candidates; operators whose result depends on equality
of words verify with the words themselves, or say that they rely on 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_MASK = (1 << 64) - 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, for at least n positions; kept while small."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, SLICE_BYTES + (1 << 16))
    made = []
    for base in (_P, _P_INVERSE):
        t = np.empty(size, np.uint64)
        t[0] = 1
        done = 1
        while done < size:  # doubling: t[done:2*done] = t[:done] * base**done
            step = min(done, size - done)
            t[done : done + step] = t[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        made.append(t)
    if size <= 4 * SLICE_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a slice of rows.

    data: bytes of the rows, one after the other.  offsets: row i is
    data[offsets[i]:offsets[i+1]].  starts, ends: of each word in data.
    word_off: words of row i are numbers word_off[i] to word_off[i+1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~_SPACE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.word_off = np.searchsorted(self.starts, offsets)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each data[start:end]."""
        up, down = _tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _Q)

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k words inside a row."""
        first = window_starts(self.word_off, k)
        return first, window_hashes(hashes, first, k)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def window_starts(word_off: np.ndarray, k: int) -> np.ndarray:
    n = int(word_off[-1])
    ok = np.ones(n, bool)
    last = np.repeat(word_off[1:], np.diff(word_off))
    ok &= np.arange(n) + k <= last
    return np.flatnonzero(ok)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0 or not len(first):
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _Q
        h += hashes[j : j + n]
    return mix(h if len(first) == n else h[first])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for slices of a text column."""
    data, offsets = text_buffer(column)
    for a, b in row_slices(offsets, limit):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)


def window_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    m, have = values, 1
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return m[:n]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as the longs that Spark keeps."""
    return x.view(np.int64)
