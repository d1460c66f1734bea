"""Benchmark decontamination by spaced seeds.

A document is contaminated by an item when a window of WINDOW consecutive words
of the document equals one of the item except for at most TOLERANCE words (A-Z
lower-cased).  A shorter item is matched whole, with a tolerance in proportion to its
length (``tolerance_of``: none under 7 words, one from 7); an item of fewer than
``least_words`` words (default LEAST_WORDS) says nothing about where its words come
from and matches nothing.  Windows are found by hashing the words at the positions that fixed
masks select: MASKS are lossless, that is any TOLERANCE substituted words in a
window leave one mask, at one of its offsets in the window, untouched.  Hashes of
the items and of the documents are joined, and every hit is verified on the words
around it: the item is laid over the document on the hit's diagonal, and windows
with enough equal words are counted.

The items' side of the join is held by every task as sorted arrays.  Its size is
bounded: items are taken in blocks of at most BLOCK_WORDS words, one pass over
the documents each, so any number of items is compared in whole.  The documents
are never shuffled.

Defined cases: null and empty texts and items have no words and match nothing;
items with the same words are one item, named by the smallest id; repeated rows
match one by one, alike; other columns of the tables are not looked at.  Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import kernel
from .shared import map_batches, with_text_columns

WINDOW = 13
TOLERANCE = 2
MASKS = ("1010011011", "111100101")
LEAST_WORDS = 5
#: Words of items that a task holds at a time (24 bytes or so for each).
BLOCK_WORDS = 1_000_000
_BITS = 20


@dataclass(frozen=True)
class Items:
    """A block of items: word hashes one item after the other, and their spaced-seed hashes, sorted."""

    ids: np.ndarray
    word_off: np.ndarray
    hashes: np.ndarray
    seeds: np.ndarray
    seed_at: np.ndarray
    present: np.ndarray  # by the low bits of a seed: whether any seed has them
    masks: tuple[str, ...]


def seed_hashes(hashes: np.ndarray, word_off: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of a mask wherever it fits into a row."""
    first = kernel.window_starts(word_off, len(mask))
    n = len(hashes) - len(mask) + 1
    if n <= 0 or not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h *= kernel._Q
            h += hashes[i : i + n]
    return first, kernel.mix(h if len(first) == n else h[first])


def tolerance_of(n_words: int | np.ndarray) -> int | np.ndarray:
    """Substituted words that an item of n words, or its window, may have."""
    return TOLERANCE * np.minimum(n_words, WINDOW) // WINDOW


def short_mask(n_words: int) -> str:
    """A mask without gaps that some offset in n words leaves untouched: one substitution leaves the first or the last half whole."""
    return "1" * (n_words // (tolerance_of(n_words) + 1))


def index_items(ids: list[int], texts: list[str], least_words: int = LEAST_WORDS) -> Items:
    words_of = [w for _, _, w in kernel.word_slices(pa.array(texts, pa.string()), lower=True)]
    hashes = np.concatenate([w.hashes() for w in words_of])
    counts = np.concatenate([w.counts() for w in words_of])
    word_off = np.concatenate([[0], np.cumsum(counts)])
    short: dict[str, list[int]] = {}
    for n in np.unique(counts).tolist():
        if max(1, least_words) <= n < WINDOW:
            short.setdefault(short_mask(n), []).append(n)
    masks = (*MASKS, *short)
    parts = []
    for mask in masks:
        at, h = seed_hashes(hashes, word_off, mask)
        n = counts[np.searchsorted(word_off, at, side="right") - 1]
        own = n >= WINDOW if mask in MASKS else np.isin(n, short[mask])
        parts.append((at[own], h[own]))
    at, seeds = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(seeds, kind="stable")
    present = np.zeros(1 << _BITS, bool)
    present[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return Items(np.array(ids, np.int64), word_off, hashes, seeds[order], at[order], present, masks)


def _item_blocks(items: DataFrame, most_words: int, least_words: int) -> Iterator[Items]:
    """Items of different words, in blocks; the driver holds one block at a time."""
    rows = (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .groupBy("text").agg(F.min("item_id").alias("item_id"))
        .orderBy("item_id")
    )
    ids, texts, n = [], [], 0
    for r in rows.toLocalIterator():
        size = len(r["text"].split())
        if ids and n + size > most_words:
            yield index_items(ids, texts, least_words)
            ids, texts, n = [], [], 0
        ids.append(-1 if r["item_id"] is None else r["item_id"])
        texts.append(r["text"])
        n += size
    if ids:
        yield index_items(ids, texts, least_words)


@dataclass(frozen=True)
class Matches:
    """For each contaminated pair of a slice: row, item, equal words in matching windows, first word of the overlap."""

    row: np.ndarray
    item: np.ndarray
    matched: np.ndarray
    at: np.ndarray


def find(words: kernel.Words, items: Items, window: int = WINDOW) -> Matches:
    hashes = words.hashes()
    hit_word, hit_seed = [], []
    for mask in items.masks:
        first, h = seed_hashes(hashes, words.word_off, mask)
        maybe = np.flatnonzero(items.present[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        left = np.searchsorted(items.seeds, h[maybe])
        count = np.searchsorted(items.seeds, h[maybe], side="right") - left
        hit_word.append(np.repeat(first[maybe], count))
        hit_seed.append(np.repeat(left - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
    at, seed = np.concatenate(hit_word), np.concatenate(hit_seed)
    none = np.zeros(0, np.int64)
    if not len(at):
        return Matches(none, none, none, none)
    place = items.seed_at[seed]
    item = np.searchsorted(items.word_off, place, side="right") - 1
    row = np.searchsorted(words.word_off, at, side="right") - 1
    # a diagonal is where the item's first word falls, counted in the slice's words
    diagonal = at - (place - items.word_off[item])
    _, one = np.unique(np.stack([row, item, diagonal]), axis=1, return_index=True)
    row, item, diagonal = row[one], item[one], diagonal[one]
    # the part of the item that lies over the row
    begin = np.maximum(diagonal, words.word_off[row])
    end = np.minimum(diagonal + items.word_off[item + 1] - items.word_off[item], words.word_off[row + 1])
    size = end - begin
    owner = np.repeat(np.arange(len(row)), size)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    doc_word = begin[owner] + offset
    item_word = items.word_off[item][owner] + doc_word - diagonal[owner]
    equal = hashes[doc_word] == items.hashes[item_word]
    total = np.concatenate([[0], np.cumsum(equal)])
    n_item = np.diff(items.word_off)[item]
    span = np.minimum(window, n_item)
    allowed = tolerance_of(n_item)
    last = np.repeat(np.cumsum(size), size)
    place = np.arange(len(owner))
    fits = place + span[owner] <= last
    starts = place[fits]
    good = total[starts + span[owner[starts]]] - total[starts] >= (span - allowed)[owner[starts]]
    starts = starts[good]
    edges = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + span[owner[starts]], -1)
    covered = np.cumsum(edges[:-1]) > 0
    matched = np.bincount(owner[covered & equal], minlength=len(row))
    first = np.full(len(row), -1)
    c = np.flatnonzero(covered)
    first[owner[c][::-1]] = doc_word[c][::-1]
    found = np.flatnonzero(matched)
    # the best diagonal of each pair: most equal words, then the earliest
    order = found[np.lexsort((first[found], -matched[found], item[found], row[found]))]
    lead = np.r_[True, (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])][: len(order)]
    order = order[lead]
    return Matches(row[order], item[order], matched[order], first[order] - words.word_off[row[order]])


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, first_word: one row for each contaminated pair."""
    made = StructType([StructField(c, LongType()) for c in ("doc_id", "item_id", "matched_words", "item_words", "first_word")])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], made)
    for items in _item_blocks(benchmark, block_words, least_words):

        def run(batches, items=items):
            for batch in batches:
                ids = batch.column(0)
                for a, _, words in kernel.word_slices(batch.column(1), lower=True):
                    m = find(words, items)
                    if len(m.row):
                        lengths = np.diff(items.word_off)[m.item]
                        columns = [ids.take(pa.array(a + m.row)), *(pa.array(c, pa.int64()) for c in (items.ids[m.item], m.matched, lengths, m.at))]
                        yield pa.RecordBatch.from_arrays(columns, names=made.fieldNames())

        found = found.unionByName(source.transform(map_batches, run, made))
    return found


def flagged(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``contaminated``."""
    out = docs.withColumn("contaminated", F.lit(False))
    for items in _item_blocks(benchmark, block_words, least_words):

        def fn(texts: pa.Array, items=items) -> list[pa.Array]:
            marks = np.zeros(len(texts), bool)
            for a, _, words in kernel.word_slices(texts, lower=True):
                marks[a + find(words, items).row] = True
            return [pa.array(marks)]

        marked = with_text_columns(out, "text", StructType([StructField("__now", BooleanType())]), fn)
        out = marked.withColumn("contaminated", F.col("contaminated") | F.col("__now")).drop("__now")
    return out if keep is None else out.select(*keep, "contaminated")
