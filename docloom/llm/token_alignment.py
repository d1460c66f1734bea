"""Alignment of the tokens of two tokenizers over the same bytes.

A (byte-level BPE) encodes space + text, B (pieces with byte fallback) the text, to
which it adds the space.  The byte ranges of B's tokens are a static interval index
(sorted ends and starts); each token of A stabs it by bisection and gets the list of
B tokens that it overlaps.  A gap between two bytes that no list spans and in which
tokens of both end is the boundary of a group; within a group every A token is linked
with every B token.

Texts are aligned stretch by stretch.  A stretch begins at a space after which, and
before which, nothing can merge with it: A's pattern begins a match there, and no
piece of B has a space after another character (checked when the model is read).  So
tokens, boundaries and groups of a text are those of its stretches in order, most of
them single words, and each different stretch is encoded and aligned once for a
worker's memo.  A text is never held as tokens, and one longer than a slice of ``PART``
bytes is worked through part by part.

The texts are encoded once, into a table of each text's figures and pairs.  Counts of
pairs are summed in tasks, then by Spark.  Of all (text, pair) rows
less than 1 in ``HOT`` can have a count of a HOT-th of them: these frequent pairs, at
most HOT, are given to the tasks that score; the others are rare, so no key of theirs
is hot, and are joined.  Documents with equal tokens ask for them once.

Defined cases: null and empty texts, and texts whose tokens do not spell space + text
in either tokenizer, have no tokens: zeros and ''.  Every row is a document, also if
it repeats another, and counts once for a pair; a null id stays null; columns other
than id and text are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .kernel import row_slices, text_buffer
from .shared import map_batches, stored

PART = 1 << 20
HOT = 1 << 20
#: Stretches in a task's memo, and the longest that is kept there, in bytes.
MEMO, LONGEST = 200_000, 256
#: Different pairs that a task sums before it writes them out.
SUMMED = 1 << 20
_SHIFT = 1 << 21  # more than B has ids
#: Words that are encoded as one text, and the largest group whose links are met one by one.
JOINED, SMALL = 100, 4096

# Which bytes a cut before a space may follow and precede; see _cuts.
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LAST_OF_SPACE = np.zeros(256, bool)  # last bytes of white space beyond ASCII, and ASCII control characters
_LAST_OF_SPACE[[*range(0x00, 0x21), 0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_FIRST_OF_SPACE = np.zeros(256, bool)
_FIRST_OF_SPACE[[*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Spaces in data at which a stretch may begin.

    The character before is no space, so B's runs of spaces stay whole; and
    either it or the character after is certainly no white space, so that A's pattern
    begins a match at the space.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    return at[(before != 0x20) & (_GRAPH[before] | _GRAPH[after] | ~_LAST_OF_SPACE[before] | ~_FIRST_OF_SPACE[after])]


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of bytes in a byte-level vocabulary: the printable ones of Latin-1 stand for themselves, the others are numbered from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids and their lengths, and ids as text before a comma, bar, semicolon or line break."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B has a space after another character, so texts can't be aligned by stretches")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(pieces)) >= _SHIFT:
            raise ValueError("a vocabulary is larger than a pair can tell")
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.said = [b"%d%c" % (i, c) for i in range(max(len(self.bytes_a), len(pieces))) for c in b",|;\n"]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], last[i]: A token i overlaps the B tokens from first[i] up to, not including, last[i].

    ends: of the tokens' byte ranges, which cover the same bytes from 0 without gaps.
    """
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    return np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a, side="left")


def boundaries(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A tokens that begin a group: no B token is in the list of one as well as in that of the one before."""
    begins = np.ones(len(first), bool)
    begins[1:] = first[1:] >= last[:-1]
    return np.flatnonzero(begins)


class Stretches:
    """Alignments of stretches, numbered; n_a, n_b, n_groups, n_links, valid: by number.  Pairs: pairs[at[i]:at[i + 1]], with weights."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []  # groups as text
        self.figures = np.zeros((0, 5), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.weights = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of ``words``, all valid until the next call."""
        if len(self.number) > MEMO:
            self.clear()
        new = [w for w in words if w not in self.number]
        if new:
            self._align(new)
        found = np.array([self.number[w] for w in words], np.int64)
        for w in new:
            if len(w) > LONGEST:  # aligned again when it is met again
                del self.number[w]
        return found

    def _align(self, words: list[str]) -> None:
        """Words that end in no white space are encoded as texts of JOINED words, for the space before each is a cut; if such a text is not spelled, word by word."""
        t = self.tokenizers
        sure = [all(c.isalpha() or "!" <= c <= "~" for c in (w[0], w[-1])) for w in words]
        plain = [w for w, x in zip(words, sure) if x]
        units = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + [[w] for w, x in zip(words, sure) if not x]
        good, bad, a, b = [], [], [], []
        while units:
            again = []
            for unit, in_a, in_b in zip(units, *t.encode([" ".join(u) for u in units])):
                spelled = " ".join(["", *unit]).encode()
                if b"".join(map(t.bytes_a.__getitem__, in_a)) == spelled == b"".join(map(t.bytes_b.__getitem__, in_b)):
                    good += unit
                    a += in_a
                    b += in_b
                elif len(unit) > 1:
                    again += [[w] for w in unit]
                else:
                    bad += unit
            units = again
        self.number |= {w: len(self.text) + i for i, w in enumerate(good + bad)}
        figures, sizes = np.zeros((len(words), 5), np.int64), np.zeros(len(words), np.int64)
        if good:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b])
            first, last = overlaps(ends_a, ends_b)
            begin_a = boundaries(first, last)
            begin_b = first[begin_a]
            n_a, n_b = np.diff(begin_a, append=len(a)), np.diff(begin_b, append=len(b))
            word = np.searchsorted(np.cumsum([len(w.encode()) + 1 for w in good]), ends_a[begin_a])  # of each group
            for i, figure in enumerate((n_a, n_b, np.ones(len(word), np.int64), n_a * n_b)):
                np.add.at(figures[:, i], word, figure)
            figures[: len(good), 4] = 1
            self.text += self._said(a, b, begin_a, begin_b, n_a, n_b, word)
            of, pairs, weights = _links(a, b, begin_a, begin_b, n_a, n_b, word)
            sizes = np.bincount(of, minlength=len(words))
            self.pairs, self.weights = np.concatenate([self.pairs, pairs]), np.concatenate([self.weights, weights])
        self.text += [b""] * len(bad)
        self.figures = np.concatenate([self.figures, figures])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def _said(self, a, b, begin_a, begin_b, n_a, n_b, word) -> list[bytes]:
        """The groups of each word as text."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[begin_a + n_a - 1] = 1
        mark_b[begin_b + n_b - 1] = np.where(np.diff(word, append=word[-1] + 1) > 0, 3, 2)
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + np.repeat(begin_b, n_a)] = a * 4 + mark_a
        said[np.arange(len(b)) + np.repeat(begin_a + n_a, n_b)] = b * 4 + mark_b
        return b"".join(map(self.tokenizers.said.__getitem__, said.tolist())).split(b"\n")[:-1]


def _links(a, b, begin_a, begin_b, n_a, n_b, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, links): all links of each group; in large groups ids that repeat are multiplied, not met one by one."""
    times = n_a * n_b
    small = np.flatnonzero(times <= SMALL)
    group = np.repeat(small, times[small])
    at = _ranges(np.zeros(len(small), np.int64), times[small])
    keys = [a[begin_a[group] + at // n_b[group]] * _SHIFT + b[begin_b[group] + at % n_b[group]]]
    of, links = [word[group]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(times > SMALL):
        (x, nx), (y, ny) = (np.unique(ids[p : p + n], return_counts=True) for ids, p, n in ((a, begin_a[g], n_a[g]), (b, begin_b[g], n_b[g])))
        keys.append((x[:, None] * _SHIFT + y).ravel())
        links.append((nx[:, None] * ny).ravel())
        of.append(np.full(len(keys[-1]), word[g]))
    return _grouped(*map(np.concatenate, (of, keys, links)))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values[order], at)


def _grouped(of: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for keys of rows: (row, key, sum), ordered by row and key."""
    if of.max(initial=0) < _SHIFT and keys.max(initial=0) < _SHIFT * _SHIFT:
        order = np.argsort(of * (_SHIFT * _SHIFT) + keys, kind="stable")
    else:
        order = np.lexsort((keys, of))
    of, keys, values = of[order], keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return of[at], keys[at], np.add.reduceat(values, at) if len(at) else values


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo[i] to hi[i], one after the other."""
    sizes = hi - lo
    return np.arange(sizes.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(lo) else np.zeros(0, np.int64)


class _Slice:
    """A slice of rows, aligned: figures and digests by row, links as (row, pair, weight)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, memo: Stretches):
        n = len(offsets) - 1
        self.figures = np.zeros((n, 4), np.int64)
        self.valid = np.diff(offsets) > 0
        digests = [hashlib.sha256() for _ in range(n)]
        begun = np.zeros(n, bool)
        links = []
        for a, b in self._parts(data, offsets):
            rows = np.searchsorted(offsets, [a, b - 1], side="right") - 1
            row, numbers = self._numbers(data[a:b], offsets[rows[0] : rows[1] + 1] - a, rows[0], memo)
            figures = memo.figures[numbers]
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            here = row[cut]
            self.valid[here] &= np.logical_and.reduceat(figures[:, 4] > 0, cut)
            self.figures[here] += np.add.reduceat(figures[:, :4], cut)
            said = [memo.text[x] for x in numbers.tolist()]
            for r, i, j in zip(here.tolist(), cut.tolist(), [*cut[1:].tolist(), len(row)]):
                digests[r].update((b";" if begun[r] else b"") + b";".join(said[i:j]))
                begun[r] = True
            own, number, times = _grouped(row, numbers, np.ones(len(row), np.int64))
            lo, hi = memo.at[number], memo.at[number + 1]
            at = _ranges(lo, hi)
            links.append(_grouped(np.repeat(own, hi - lo), memo.pairs[at], memo.weights[at] * np.repeat(times, hi - lo)))
        none = np.zeros(0, np.int64)
        self.row, self.pair, self.weight = (np.concatenate([part[i] for part in links]) if links else none for i in range(3))
        if len(links) > 1:
            self.row, self.pair, self.weight = _grouped(self.row, self.pair, self.weight)
        good = self.valid[self.row]
        self.row, self.pair, self.weight = self.row[good], self.pair[good], self.weight[good]
        self.figures[~self.valid] = 0
        self.digests = [d.hexdigest() if ok else "" for d, ok in zip(digests, self.valid)]

    @staticmethod
    def _parts(data: np.ndarray, offsets: np.ndarray):
        """The slice as one part; a long text in parts of about PART bytes that end at cuts."""
        at, end = 0, len(data)
        if len(offsets) == 2:
            while end - at > 2 * PART:
                # a cut is looked for from PART on, in ever longer stretches
                step = PART
                while True:
                    found = _cuts(data[at + PART - 1 : at + PART + step])
                    if len(found) or at + PART + step >= end:
                        break
                    step *= 2
                if not len(found):
                    break
                to = at + PART - 1 + int(found[0])
                yield at, to
                at = to
        if end > at:
            yield at, end

    @staticmethod
    def _numbers(data: np.ndarray, inner: np.ndarray, first_row: int, memo: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of each stretch; inner: where the rows of the part begin, the first maybe before it."""
        begins = np.zeros(len(data) + 1, bool)
        cuts = _cuts(data)
        begins[cuts] = True
        starts = inner[(inner > 0) & (inner < len(data))]
        # a space at either edge of a text is no cut
        begins[starts - 1] = begins[starts] = False
        space = begins[:-1].copy()  # a stretch that begins at a space begins after it, for both add it
        begins[starts] = True
        begins[0] = True
        if inner[0] < 0 and data[0] == 0x20:  # a part that goes on with a text begins at a cut
            space[0] = True
        at = np.flatnonzero(begins[:-1])
        ends = np.append(at[1:], len(data))
        row = first_row + np.searchsorted(inner, at, side="right") - 1
        at = at + space[at]
        sizes = ends - at
        whole = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(np.ascontiguousarray(data[_ranges(at, ends)])))
        coded = whole.dictionary_encode()
        return row, memo.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]


_memos: dict[tuple[str, str], Stretches] = {}


def _memo(path_a: str, path_b: str) -> Stretches:
    if (path_a, path_b) not in _memos:
        _memos[path_a, path_b] = Stretches(Tokenizers(path_a, path_b))
    return _memos[path_a, path_b]


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = [StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in FIGURES), StructField("groups_sha256", StringType())]
_LINKS = [StructField("pairs", ArrayType(LongType())), StructField("links", ArrayType(LongType()))]
ALIGNED = StructType(_ALIGNED + _LINKS)
COUNTS = StructType([StructField("pair", LongType()), StructField("n", LongType())])
SCORED = StructType([*_ALIGNED, StructField("n_best", LongType()), StructField("count_sum", LongType()), *_LINKS])


def _lists(row: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """The values of each of n rows as a list."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, figures, groups_sha256, and the different linked pairs (A * 2**21 + B) with their links; docs: doc_id, text."""

    def run(batches):
        memo = _memo(path_a, path_b)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets, PART):
                part = _Slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], memo)
                figures = [pa.array(np.ascontiguousarray(c)) for c in part.figures.T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *figures, pa.array(part.digests, pa.string()), *_lists(part.row, b - a, part.pair, part.weight)], names=ALIGNED.fieldNames())

    return map_batches(docs.select("doc_id", "text"), run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: the rows of ``aligned`` that hold the pair."""

    def run(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column(0).flatten().to_numpy()
            for a in range(0, len(own), SUMMED):
                more = _summed(own[a : a + SUMMED], np.ones(len(own[a : a + SUMMED]), np.int64))
                keys, n = _summed(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]]))
                if len(keys) > SUMMED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=COUNTS.fieldNames())
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=COUNTS.fieldNames())

    return map_batches(found.select("pairs"), run, COUNTS).groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(found: DataFrame, frequent: tuple[np.ndarray, np.ndarray], best: np.ndarray) -> DataFrame:
    """n_best and count_sum of each row of ``aligned`` over its frequent pairs; the others stay in pairs and links."""
    given = found.sparkSession.sparkContext.broadcast((*frequent, best))  # at most HOT pairs and a number for each id of A

    def run(batches):
        keys, counts, most = given.value
        for batch in batches:
            n = batch.num_rows
            pairs, links = (batch.column(i).flatten().to_numpy() for i in (6, 7))
            row = np.repeat(np.arange(n), batch.column(6).value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            count = counts[at[known]]
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], row[known], np.where(count == most[pairs[known] // _SHIFT], links[known], 0))
            np.add.at(sums[1], row[known], links[known] * count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(s) for s in sums), *_lists(row[~known], n, pairs[~known], links[~known])], names=SCORED.fieldNames())

    return map_batches(found.select(ALIGNED.fieldNames()), run, SCORED)


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for ``docs`` (doc_id, text).

    path_a: a byte-level tokenizer for the library ``tokenizers``; path_b: a model
    for ``sentencepiece``; both where every executor can read them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(aligned(docs, path_a, path_b))
    counts = stored(pair_counts(found))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * hot >= F.lit(total)  # at most ``hot`` pairs
    known = counts.where(frequent).sort("pair").toArrow()
    first = F.floor(F.col("pair") / _SHIFT).cast("long")
    tops = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))  # at most one row for each entry of A's vocabulary
    table = tops.toArrow()
    ids, most = (table.column(i).to_numpy() for i in range(2))
    best = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    best[ids] = most
    scored = stored(_scored(found, tuple(known.column(i).to_numpy() for i in range(2)), best))
    columns = ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"]
    # a text with rare pairs is rare itself, so neither its digest nor its pairs are hot keys
    open_ = scored.where(F.size("pairs") > 0)
    asked = open_.dropDuplicates(["groups_sha256"]).select("groups_sha256", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("groups_sha256", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    rare = counts.where(~frequent).withColumn("a", first).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    sums = asked.join(rare, "pair").groupBy("groups_sha256").agg(F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    done = open_.select(columns).join(sums, "groups_sha256").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return scored.where(F.size("pairs") == 0).select(columns).unionByName(done.select(columns))
