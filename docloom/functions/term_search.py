"""Words of lower-cased texts as places in a vocabulary, and the best documents of queries, on Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Bytes of the texts, and (query, document) cells, that a task works on at a time.
SLICE_BYTES, CELLS = 1 << 19, 1 << 18
POINTS = 0x110000

_points: list[np.ndarray] = []


def word_points(spark: SparkSession) -> np.ndarray:
    """Which code points T.WORD_PATTERN takes, as this cluster's Java knows them; asked once."""
    if not _points:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = spark.range(POINTS).where("id not between 55296 and 57343").where(F.concat(char, char).rlike(f"^{T.WORD_PATTERN}$")).toArrow()
        _points.append(np.isin(np.arange(POINTS), found["id"].to_numpy()))
    return _points[0]


def _spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end of every run of two or more word characters inside a row, which bytes these are)."""
    inside = word[data]  # right for ASCII
    p = np.flatnonzero(data >= 0x80)
    inside[p] = False
    p = p[data[p] >= 0xC0]
    byte = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    first, second, third, fourth = (byte[p + i] & 63 if i else byte[p] for i in range(4))
    point = np.where(first < 0xE0, (first & 31) << 6 | second, np.where(first < 0xF0, (first & 15) << 12 | second << 6 | third, (first & 7) << 18 | second << 12 | third << 6 | fourth))
    taken = word[np.minimum(point, POINTS - 1)]
    for i, least in enumerate((0, 0, 0xE0, 0xF0)):
        at = p[taken & (first >= least)] + i
        inside[at[at < len(data)]] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = after[inner - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    alone = np.flatnonzero(chars[end] - chars[begin] < 2)
    for i in range(4):
        at = begin[alone] + i
        inside[at[at < end[alone]]] = False
    long = np.ones(len(begin), bool)
    long[alone] = False
    return begin[long], end[long], inside


def words_of(column: pa.Array, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """(first row, end row, row of each word, words) for slices of a text column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1), len(column))
        offsets = at[a : b + 1] - at[a]
        data = whole[at[a] : at[b]]
        begin, end, inside = _spans(data, offsets, word)
        place = np.r_[0, np.cumsum(end - begin)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(place), pa.py_buffer(data[inside])])
        yield a, b, np.searchsorted(offsets, begin, side="right") - 1, words
        a = b


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark rounds: a half of the shortest decimal text goes up."""
    y = x * 10.0**digits
    below = np.floor(y)
    rest = y - below
    out = (below + (rest >= 0.5)) / 10.0**digits
    at = np.nonzero(np.abs(rest - 0.5) < 1e-4)
    out[at] = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in x[at].tolist()]
    return out


@dataclass(frozen=True)
class Weights:
    """What a share of each term adds to a query's score: the pairs of term t are at[t] to at[t + 1] in query and w."""

    at: np.ndarray
    query: np.ndarray
    w: np.ndarray
    queries: int

    @staticmethod
    def of(terms: int, term: np.ndarray, query: np.ndarray, w: np.ndarray, queries: int) -> Weights:
        order = np.lexsort((query, term))
        return Weights(np.searchsorted(term[order], np.arange(terms + 1)), query[order], w[order], queries)

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        """[query, document]: sums of w times part over postings, added in the order of terms."""
        n = self.at[term + 1] - self.at[term]
        of = np.repeat(np.arange(len(n)), n)
        pair = np.arange(len(of)) + np.repeat(self.at[term] - (np.cumsum(n) - n), n)
        return np.bincount(self.query[pair] * docs + doc[of], self.w[pair] * part[of], self.queries * docs).astype(np.float64).reshape(self.queries, docs)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the k greatest scores above 0 of each row; of equal ones the first places."""
    n = scores.shape[1]
    bound = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(scores))
    out = []
    for row, least in zip(scores, bound):
        near = np.flatnonzero((row >= least) & (row > 0))
        out.append(near[np.argsort(-row[near], kind="stable")][:k])
    return np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate(out)
