"""Language-model scoring with a causal self-attention model trained in numpy.

Tokens of the count figures are words (A-Z lower-cased) and one end for each text.
The model reads subword ids: each word with a space before it, encoded with the
first RANKS merges of a public rank file, and an id for the end.

Model.  Counts of all neighbouring ids in the training texts give P(id | last id).
Ids have fixed embeddings (leading directions of those counts) and classes
(clusters of the embeddings).  One head of causal self-attention over the window
reads the embeddings of the ids so far and yields a weight for each class, which
tilts the bigram distribution:

    p(id | window) = P(id | last) exp(s[class(id)]) / sum_c P(class c | last) exp(s[c])

so it is normalised by a sum over classes alone.  The attention is what knows the
language and style of a text beyond the last id.  Runs of three ids that repeat are a
memory beside it: P(id | last two) is the discounted share of the run, and what the
runs leave of the probability is the attention's.

A unit is a word or the end.  With B the probability that the next id begins a unit,
a word's probability after a text is the product over its ids, times B after it (it
goes no further), over B before it; the end has no B after it.  So the units that can
follow share a probability of 1, and so do their frequencies among the training units,
with which that is mixed with a weight of WORD_SHARE.  A text's score is the product
over its units: over all sequences of words it sums to 1 at most (less, by what goes
to strings of ids that no word is encoded as).

Scoring uses overlapping windows: each holds CONTEXT ids that were scored before
and STRIDE ids that are scored in it, so every id is scored once with at least
CONTEXT ids of context where the text has them; windows are batched with a mask.

Training.  Counts are summed over all training texts.  Training texts are dealt to
shards of about SHARD_IDS ids by a hash of the row; the attention is fitted for each
shard on all windows of all its texts (Adagrad, one pass, texts in order of id), and
the shards' weights are averaged in proportion to their windows, so the work follows
the input.  Averages are sums of whole numbers and shards depend on the rows alone, so
neither files, partitions nor lost tasks change a weight.

Every repeated run and every word of the training texts takes part: tasks hold the
RUNS and WORDS most frequent, and the others are joined with the texts' ids and words
(by a 64-bit hash), so what is gathered grows with the input.  Each of the others has
at most 1/WORDS or 1/RUNS of the training tokens, so no key of that join is hot.

Defined cases: a null or empty text is its end; a null id counts as the empty
string in the split; repeated rows are counted and scored one by one; with no
training text the model is uniform over ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from . import byte_bpe, kernel
from .shared import map_batches, release, stored

RANKS = 2048
#: Words that a task holds (the most frequent); the others are joined.
WORDS = 1 << 18
#: Weight of the words' own frequencies in a word's probability.
WORD_SHARE = 0.2
#: Runs of three ids that a task holds (the most frequent; the others are joined), and what is taken off the counts.
RUNS = 1 << 21
DISCOUNT = 0.75
WIDTH = 16
CLASSES = 64
CONTEXT, STRIDE = 16, 16
#: Training ids of a shard, for which one set of attention weights is fitted.
SHARD_IDS = 1 << 20
#: Words that a process remembers the ids of.
MET = 1 << 18
#: Counts that a task holds before it sends some on; how many changes no sum.
HELD = 1_000_000
_SPAN = CONTEXT + STRIDE
_END_HASH = np.uint64(0x5E9D_0000_0000_0001)  # the end as a word


class Subwords:
    """Ids of words by the first ``ranks`` merges; ``end`` is the id after those of the ranks."""

    def __init__(self, path: str, ranks: int):
        full = byte_bpe.read_ranks(path)
        kept = sorted((r, t) for t, r in full.items() if r < ranks or len(t) == 1)
        self.encoding = tiktoken.Encoding("first merges", pat_str=" [^ ]+", mergeable_ranks={t: i for i, (_, t) in enumerate(kept)}, special_tokens={})
        self.end = len(kept)
        self.size = len(kept) + 1
        #: ids that begin a word (with the space before it) or are the end
        self.begins = np.array([t[:1] == b" " for _, t in kept] + [True])
        self._forget()

    def _encoded(self, words: kernel.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each of the words ``which`` and the end)."""
        start, size = words.starts[which], (words.ends - words.starts)[which] + 1
        begin = np.cumsum(size) - size
        spaced = words.data.take(np.arange(int(size.sum())) + np.repeat(start - 1 - begin, size), mode="clip")
        spaced[begin] = 32
        ids = self.encoding.encode_to_numpy(spaced.tobytes().decode(), disallowed_special=()).astype(np.int64)
        return ids, np.append(np.flatnonzero(self.begins[ids]), len(ids))

    def _forget(self) -> None:
        self.met, self.ids, self.sizes = Lookup(np.array([_END_HASH]), MET), np.array([self.end]), np.ones(1, np.int64)

    def _places(self, words: kernel.Words, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among those met; what is new is encoded."""
        place = self.met.find(hashes)
        new = np.flatnonzero(place < 0)
        fresh, first = np.unique(hashes[new], return_index=True)
        if len(self.met.keys) + len(fresh) > MET:
            self._forget()
            new = np.arange(len(hashes))
            fresh, first = np.unique(hashes, return_index=True)
        if len(new):
            ids, at = self._encoded(words, new[first])
            self.met.add(fresh)
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, np.diff(at))
            place[new] = self.met.find(hashes[new])
        return place

    def sequence(self, words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each unit, first unit of each row, hash of each unit); a unit is a word or an end.

        A word that was met before, by its hash as in all counts, is not encoded again.
        """
        hashes = words.hashes()
        place = np.insert(self._places(words, hashes), words.word_off[1:], 0)
        size = self.sizes.take(place)
        at = np.cumsum(size) - size
        first = np.cumsum(self.sizes) - self.sizes
        ids = self.ids.take(np.arange(int(size.sum())) + np.repeat(first.take(place) - at, size))
        return ids, at, words.word_off + np.arange(len(words.word_off)), np.insert(hashes, words.word_off[1:], _END_HASH)


@lru_cache(maxsize=1)
def subwords(path: str, ranks: int) -> Subwords:
    return Subwords(path, ranks)


def _small(values: np.ndarray) -> bytes:
    """Whole numbers as the compressed steps between them, for broadcasts, which every executor writes to its disk."""
    return zlib.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 1)


def _whole(small: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(small), np.int64))


@dataclass(frozen=True)
class Tables:
    """What counts give: embeddings, classes, log P(id | last), P(class | last), P(class, begins a unit | last); and the counts that are not 0, by which it travels."""

    embedding: np.ndarray
    of_class: np.ndarray
    log_next: np.ndarray
    class_next: np.ndarray
    begins: np.ndarray
    begin_next: np.ndarray
    cells: tuple[bytes, bytes]

    def __reduce__(self):
        return _tables_of, (self.embedding, self.of_class, self.begins, self.cells)

    @cached_property
    def wide(self) -> np.ndarray:
        """Embeddings, and a 1 after each: a product with it also gives the sum of what it is weighed with."""
        return _with_one(self.embedding)


def _with_one(m: np.ndarray) -> np.ndarray:
    return np.concatenate([m, np.ones((*m.shape[:-1], 1), m.dtype)], axis=-1)


def _next(pairs: np.ndarray) -> np.ndarray:
    """P(id | last)."""
    follow = pairs.sum(axis=0)
    unigram = (follow + 0.5) / (follow.sum() + 0.5 * len(pairs))
    backing = 5.0
    return ((pairs + backing * unigram[None]) / (pairs.sum(axis=1, keepdims=True) + backing)).astype(np.float32)


def _tables_of(embedding: np.ndarray, of_class: np.ndarray, begins: np.ndarray, cells: tuple[bytes, bytes]) -> Tables:
    n = len(embedding)
    pairs = np.zeros(n * n)
    pairs[_whole(cells[0])] = _whole(cells[1])
    p = _next(pairs.reshape(n, n))
    member = np.zeros((n, CLASSES), np.float32)
    member[np.arange(n), of_class] = 1
    return Tables(embedding, of_class, np.log(p), p @ member, begins, p[:, begins] @ member[begins], cells)


def tables(pairs: np.ndarray, begins: np.ndarray | None = None) -> Tables:
    """From pairs[last, next], the counts of neighbouring ids, and which ids begin a unit (all, if None)."""
    n = len(pairs)
    begins = np.ones(n, bool) if begins is None else begins
    rng = np.random.default_rng(5)
    follow = pairs.sum(axis=0)
    # leading directions of the counts on a log scale, from both sides, by subspace iteration
    logs = np.log1p(pairs).astype(np.float32)
    logs -= logs.mean(axis=0, keepdims=True)
    sides = []
    for m in (logs, logs.T):
        basis = rng.standard_normal((n, WIDTH // 2)).astype(np.float32)
        for _ in range(12):
            basis = np.linalg.qr(m.T @ (m @ basis))[0].astype(np.float32)
        sides.append(m @ basis)
    embedding = np.concatenate(sides, axis=1)
    embedding /= np.linalg.norm(embedding, axis=1, keepdims=True) + 1e-3
    classes = min(CLASSES, n)
    weight = np.sqrt(follow + 1)
    centre = embedding[np.argsort(-follow, kind="stable")[:classes]].copy()
    of_class = np.zeros(n, np.int64)
    for _ in range(12):
        of_class = np.argmax(embedding @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        total = np.bincount(of_class, weights=weight, minlength=classes)
        for d in range(WIDTH):
            centre[:, d] = np.bincount(of_class, weights=weight * embedding[:, d], minlength=classes) / np.maximum(total, 1e-9)
    at = np.flatnonzero(pairs)
    return _tables_of((embedding * 2).astype(np.float32), of_class, begins, (_small(at), _small(pairs.ravel()[at].astype(np.int64))))


_SHAPES = {"query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "mixed": (WIDTH, WIDTH), "near": (_SPAN,), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = {k: (0.3 * rng.standard_normal(s)).astype(np.float32) for k, s in _SHAPES.items()}
    for k in ("near", "out", "bias"):
        made[k][:] = 0
    made["out"] = (0.05 * rng.standard_normal(_SHAPES["out"])).astype(np.float32)
    return made


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES]).astype(np.float64)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return _named(flat.astype(np.float32))


def _named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views into ``flat``."""
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


_DISTANCE = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(_SPAN)[None]  # from a scored place back to a key
_CAUSAL = _DISTANCE >= 0


@dataclass(frozen=True)
class Windows:
    """Batched windows: ids that are read [n, _SPAN], which of them exist, ids to score [n, STRIDE], which exist, their places."""

    read: np.ndarray
    there: np.ndarray
    target: np.ndarray
    scored: np.ndarray
    place: np.ndarray


def window_places(row_from: np.ndarray, row_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first scored place, begin of its row, end of its row) of every window."""
    n = -(-(row_to - row_from) // STRIDE)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row_from[row] + step * STRIDE, row_from[row], row_to[row]


def batch(ids: np.ndarray, shifted: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> Windows:
    keys = first[:, None] - CONTEXT + np.arange(_SPAN)[None]
    there = (keys >= low[:, None]) & (keys < high[:, None])
    place = first[:, None] + np.arange(STRIDE)[None]
    scored = place < high[:, None]
    place = np.minimum(place, len(ids) - 1)
    return Windows(shifted.take(keys, mode="clip"), there, ids.take(place), scored, place)


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _sums(m: np.ndarray) -> np.ndarray:
    """Sums over the last axis; faster than ``sum`` on rows this short."""
    return np.einsum("...j->...", m)


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b over all windows, in eight parts: BLAS has a quicker way for products of at most a million steps."""
    n = len(a) // 8 * 8
    parts = (m[:n].reshape(8, -1, m.shape[-1]) for m in (a, b))
    out = np.add.reduce(np.matmul(next(parts).transpose(0, 2, 1), next(parts)), axis=0)
    return out + _flat(a[n:]).T @ _flat(b[n:]) if n < len(a) else out


_SCALE = np.float32(1 / np.sqrt(WIDTH))


def _weighed(near: np.ndarray, a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """exp of the attention scores ``a``, which are used up: 0 for ids to come and for those that do not exist."""
    a += np.where(_CAUSAL, near[np.maximum(_DISTANCE, 0)], np.float32(-1e4))
    cut = np.flatnonzero(~(there[:, 0] & there[:, -1]))  # what exists is one range
    a[cut] += np.where(there[cut], np.float32(0), np.float32(-1e4))[:, None]
    if a.max(initial=0) > 60:
        np.minimum(a, np.float32(60), out=a)  # a scored id always sees the id before it, so no row is empty
    return np.exp(a, out=a)


def _limited(s: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """``s``, so that it is between -8 and 8 with ``bias``; most batches have nothing beyond, and to look is cheaper than to clip."""
    low, high = (-8, 8) if bias is None else (-8 - bias, 8 - bias)
    return np.clip(s, low, high, out=s) if s.max(initial=0) > np.min(high) or s.min(initial=0) < np.max(low) else s


def forward(w: dict[str, np.ndarray], t: Tables, x: Windows, scores: bool = True) -> tuple[np.ndarray | None, tuple]:
    """log p of every target (if ``scores``), and what the backward pass needs.

    An id's key and value are products of its embedding with fixed weights, so the
    weights are multiplied first: the scores are own (query key') read', and what is
    seen is (weights read) (value mixed).
    """
    last = x.read[:, CONTEXT:]
    e = t.embedding.take(x.read, axis=0)
    across = np.ascontiguousarray(e.transpose(0, 2, 1))  # a product with a transposed view takes several times as long
    own = t.embedding.take(last, axis=0)
    a = _weighed(w["near"], (own @ ((w["query"] @ w["key"].T) * _SCALE)) @ across, x.there)
    total = _sums(a)[..., None]
    seen = a @ e
    seen /= total
    h = t.wide.take(last, axis=0)
    h[..., :WIDTH] += seen @ (w["value"] @ w["mixed"])
    s = _flat(_limited(h @ np.concatenate([w["out"], w["bias"][None]])))
    last, c = last.ravel(), t.of_class.take(x.target.ravel())
    own_s = s[np.arange(len(c)), c] if scores else None
    tilted = np.exp(s, out=s)
    tilted *= t.class_next.take(last, axis=0)
    z = tilted @ np.ones(tilted.shape[1], tilted.dtype)
    log_p = (t.log_next[last, x.target.ravel()] + own_s - np.log(z)).reshape(x.target.shape) if scores else None
    return log_p, (e, across, own, a, total, seen, h, tilted, z, c)


@dataclass(frozen=True)
class Scorer:
    """``forward`` for fixed weights: what an id gives as query, key and value is made once, and windows only look it up.

    A product of many rows rounds a row by its place among them.  So the products here
    are made window by window, and a window's score is the same in every batch.
    """

    w: dict[str, np.ndarray]
    t: Tables
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray  # as mixed into the id's own embedding
    class_next: np.ndarray  # these two times exp(bias)
    begin_next: np.ndarray

    @classmethod
    def of(cls, w: dict[str, np.ndarray], t: Tables) -> Scorer:
        bias = np.exp(w["bias"])
        return cls(w, t, t.embedding @ w["query"] * _SCALE, t.embedding @ w["key"], t.embedding @ w["value"] @ w["mixed"], t.class_next * bias, t.begin_next * bias)

    def log_p(self, x: Windows) -> np.ndarray:
        """log p of every target."""
        return self.scores(x)[0]

    def scores(self, x: Windows) -> tuple[np.ndarray, np.ndarray]:
        """log p of every target; and where it begins a unit, the probability that some id does (elsewhere 1)."""
        t, w, last = self.t, self.w, x.read[:, CONTEXT:]
        a = self.query.take(last, axis=0) @ np.ascontiguousarray(self.key.take(x.read, axis=0).transpose(0, 2, 1))
        a = _weighed(w["near"], a, x.there)
        h = a @ self.value.take(x.read, axis=0)
        h /= _sums(a)[..., None]
        h += t.embedding.take(last, axis=0)
        s = _flat(_limited(h @ w["out"], w["bias"]))
        last, target = last.ravel(), x.target.ravel()
        c = t.of_class.take(target)
        own = s.ravel().take(np.arange(0, s.size, s.shape[1]) + c) + w["bias"].take(c)
        np.exp(s, out=s)
        z = np.einsum("jk,jk->j", s, self.class_next.take(last, axis=0))
        begin = np.ones(z.size, np.float32)
        at = np.flatnonzero(t.begins.take(target))
        begin[at] = np.einsum("jk,jk->j", s.take(at, axis=0), self.begin_next.take(last.take(at), axis=0)) / z.take(at)
        log_p = t.log_next.ravel().take(last * len(t.log_next) + target) + own - np.log(z)
        return log_p.reshape(x.target.shape), begin.reshape(x.target.shape)


def slopes(w: dict[str, np.ndarray], x: Windows, kept: tuple) -> dict[str, np.ndarray]:
    """Gradient of the mean log p of the scored targets; ``kept`` is used up."""
    e, across, own, a, total, seen, h, d, z, c = kept
    d[np.arange(len(c)), c] -= z
    d *= (x.scored.ravel() / (z * np.float32(-max(int(x.scored.sum()), 1))))[:, None]
    d = d.reshape(*h.shape[:2], -1)
    out = _across(h, d)
    g = {"out": out[:WIDTH], "bias": out[WIDTH]}
    dh = d @ np.ascontiguousarray(w["out"].T)
    mixed = _across(seen, dh)
    g["mixed"], g["value"] = w["value"].T @ mixed, mixed @ w["mixed"].T
    dseen = dh @ np.ascontiguousarray((w["value"] @ w["mixed"]).T)
    dseen /= total
    da = dseen @ across
    da -= np.einsum("nid,nid->ni", dseen, seen)[..., None]
    da *= a
    g["near"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), weights=da.sum(axis=0).ravel(), minlength=_SPAN)
    pair = _across(own, da @ e) * _SCALE
    g["query"], g["key"] = pair @ w["key"], pair.T @ w["query"]
    return g


class Trainer:
    """Adagrad over batches of windows, from the start weights."""

    def __init__(self, t: Tables, rate: float = 0.1, size: int = 128):
        self.t, self.rate, self.size, self.n = t, rate, size, 0
        self.flat = pack(start_weights()).astype(np.float32)
        self.w = _named(self.flat)
        self.squares = np.full(len(self.flat), 1e-8)

    def take(self, ids: np.ndarray, shifted: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for i in range(0, len(first), self.size):
            s = slice(i, i + self.size)
            x = batch(ids, shifted, first[s], low[s], high[s])
            g = pack(slopes(self.w, x, forward(self.w, self.t, x, scores=False)[1]))
            self.squares += g * g
            self.flat += (self.rate * g / np.sqrt(self.squares)).astype(np.float32)
            self.n += len(x.read)


def _shifted(ids: np.ndarray, row_from: np.ndarray, end: int) -> np.ndarray:
    """The id before each; before a row's first, the end."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[row_from] = end
    return out


def split_column(key: str = "doc_id"):
    """True for a held-out row: crc32 of the id as text leaves 1 when divided by 5."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5) == 1


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), split_column().alias("held_out"), text.alias("text"))


def word_counts(train: DataFrame) -> DataFrame:
    """word (hash), count over all training texts; the end is a word."""
    made = StructType([StructField("word", LongType()), StructField("count", LongType())])

    def rows(h, c):
        return pa.RecordBatch.from_arrays([pa.array(kernel.signed(h)), pa.array(c)], names=made.fieldNames())

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0
        for b in batches:
            for _, _, words in kernel.word_slices(b.column(0), lower=True):
                ends += words.rows
                h, c = np.unique(words.hashes(), return_counts=True)
                held.append((h, c.astype(np.int64)))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*_added(held))
        if ends:
            yield rows(np.array([_END_HASH]), np.array([ends], np.int64))

    return train.select("text").transform(map_batches, run, made).groupBy("word").agg(F.sum("count").alias("count"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(h)
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h[begin], np.add.reduceat(c, begin) if len(begin) else c


def _codes(ids: np.ndarray, last: np.ndarray, row_from: np.ndarray, own: Subwords) -> np.ndarray:
    """(id two before, id before, id) of every id as one number."""
    return (_shifted(last, row_from, own.end).astype(np.int64) * own.size + last) * own.size + ids


class Lookup:
    """Places of 64-bit keys by open addressing: a few gathers for each number instead of a binary search."""

    def __init__(self, keys: np.ndarray, room: int = 1):
        self.keys, self.room = keys.astype(np.uint64) if keys.dtype != np.uint64 else keys, room
        self.place = None  # made when first asked: the driver never is

    def __reduce__(self):
        return Lookup, (self.keys, self.room)

    def _fill(self) -> None:
        self.bits, self.probes = max(10, int(4 * max(len(self.keys), self.room)).bit_length() - 1), 0  # 2 to 4 slots for each key
        self.place = np.full(1 << self.bits, -1, np.int32)
        self._put(0)

    def _put(self, begin: int) -> None:
        """Gives a slot to each key from number ``begin`` on."""
        left, probe = np.arange(begin, len(self.keys), dtype=np.int32), 0
        slot = self._slot(self.keys[begin:])
        while len(left):
            at = (slot[left - begin] + probe) & ((1 << self.bits) - 1)
            free = self.place[at] < 0
            self.place[at[free]] = left[free]  # of several, one stays
            left = left[self.place[at] != left]
            probe += 1
        self.probes = max(self.probes, probe)
        self.padded = np.append(self.keys, np.uint64(0))

    def add(self, keys: np.ndarray) -> None:
        """More keys, none of which is there; their places follow."""
        begin = len(self.keys)
        self.keys = np.append(self.keys, keys)
        if self.place is None or len(self.keys) > self.room:
            self._fill()
        else:
            self._put(begin)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the keys, or -1."""
        if self.place is None:
            self._fill()
        keys = keys.astype(np.uint64) if keys.dtype != np.uint64 else keys
        slot = self._slot(keys)
        place = self.place[slot]
        out = np.where(self.padded[place] == keys, place, -1)
        open_ = np.flatnonzero((out < 0) & (place >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + probe) & ((1 << self.bits) - 1)
            place = self.place[at]
            hit = (place >= 0) & (self.padded[place] == keys[open_])
            out[open_[hit]] = place[hit]
            open_ = open_[~hit & (place >= 0)]
        return out


@dataclass(frozen=True)
class Memory:
    """Runs of three ids: codes and counts of the most frequent; for each two ids their count, what the shares of all repeated runs leave, and the shares of those that begin a unit."""

    code: Lookup
    count: np.ndarray
    totals: np.ndarray
    left: np.ndarray
    begun: np.ndarray

    def __reduce__(self):
        two = np.flatnonzero(self.totals)
        return _memory_of, (_small(self.code.keys), _small(self.count), len(self.left), _small(two), _small(self.totals[two]), self.left[two], self.begun[two])

    def counts(self, code: np.ndarray) -> np.ndarray:
        """Counts; 0 for a run that is not among the most frequent."""
        return np.append(self.count, 0)[self.code.find(code)]

    def mixed(self, code: np.ndarray, count: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """log of share + left * p; ``count`` is 0 for a run that does not repeat."""
        two = code // round(len(self.left) ** 0.5)
        p = np.exp(log_p) * self.left[two]
        kept = np.flatnonzero(count)
        p[kept] += (count[kept] - DISCOUNT) / self.totals[two[kept]]
        return np.log(p)

    def log_begin(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log of the probability that an id begins a unit where runs ``code`` end, from that of the attention."""
        two = code // round(len(self.left) ** 0.5)
        return np.log(self.begun[two] + self.left[two] * begin.astype(np.float64))


def _memory_of(code: bytes, count: bytes, size: int, two: bytes, total: bytes, kept: np.ndarray, begin: np.ndarray) -> Memory:
    totals, left, begun = np.zeros(size, np.uint32), np.ones(size, np.float32), np.zeros(size, np.float32)
    at = _whole(two)
    totals[at], left[at], begun[at] = _whole(total), kept, begin
    return Memory(Lookup(_whole(code)), _whole(count).astype(np.int32), totals, left, begun)


def _id_slices(batches, column: int = 0, most: int = 1 << 19):
    """(ids, begin of each row, end of each row) for slices of rows of stored ids."""
    for b in batches:
        packed = b.column(column)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        every = np.frombuffer(packed.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0])
        offsets = (offsets - offsets[0]) // 2
        for a, c in kernel.row_slices(offsets, most):
            yield every[offsets[a] : offsets[c]].astype(np.int64), offsets[a:c] - offsets[a], offsets[a + 1 : c + 1] - offsets[a]


def run_counts(train: DataFrame, path: str, ranks: int) -> DataFrame:
    """code, count: runs of three ids over all training texts."""
    made = StructType([StructField("code", LongType()), StructField("count", LongType())])

    def rows(c, n):
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=made.fieldNames())

    def run(batches):
        own = subwords(path, ranks)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, row_from, _ in _id_slices(batches):
            code, count = np.unique(_codes(ids, _shifted(ids, row_from, own.end), row_from, own), return_counts=True)
            held.append((code, count.astype(np.int64)))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_added(held)]
                if len(held[0][0]) > HELD // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*_added(held))

    return train.select("ids").transform(map_batches, run, made).groupBy("code").agg(F.sum("count").alias("count"))


def pairs_and_memory(runs: DataFrame, begins: np.ndarray, most: int = RUNS) -> tuple[np.ndarray, Memory]:
    """pairs[last, next], and the memory with the most frequent runs; size**2 (size: the ids) and ``most`` numbers reach the driver at most."""
    size = len(begins)
    cells = runs.groupBy((F.col("code") % (size * size)).cast("int").alias("cell")).agg(F.sum("count").alias("count")).toArrow()
    pairs = np.zeros(size * size)
    pairs[cells["cell"].to_numpy()] = cells["count"].to_numpy()
    found = runs.where(F.col("count") >= max(2, _least_count(runs, most))).select("code", "count").toArrow()
    code, count = found["code"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(code)
    left = F.when(F.col("count") > 1, DISCOUNT).otherwise(1.0)
    begun = F.when((F.col("count") > 1) & (F.col("code") % size).isin(np.flatnonzero(begins).tolist()), F.col("count") - DISCOUNT).otherwise(0.0)
    twos = runs.groupBy(F.expr(f"cast(code div {size} as int)").alias("two")).agg(F.sum("count").alias("count"), F.sum(left).alias("left"), F.sum(begun).alias("begun")).toArrow()
    at, total = twos["two"].to_numpy(), twos["count"].to_numpy()
    by_two = np.argsort(at)
    left, begun = ((twos[c].to_numpy() / total).astype(np.float32)[by_two] for c in ("left", "begun"))
    return pairs.reshape(size, size), _memory_of(_small(code[order]), _small(count[order]), size * size, _small(at[by_two].astype(np.int64)), _small(total[by_two]), left, begun)


#: Weights are summed as multiples of 1/_UNIT; so many shards fit a 64-bit sum.
_UNIT = float(1 << 32)
_SUMMED = 1 << 8


def fit_attention(train: DataFrame, t: Tables, path: str, ranks: int, n_ids: int, shared=None) -> dict[str, np.ndarray]:
    """Average of the shards' weights; a shard is trained on every window of all its texts.

    train: doc_id, ids, of n_ids ids in all.
    """
    made = StructType([StructField("place", IntegerType()), StructField("weighted", LongType()), StructField("windows", LongType())])
    shared = shared or train.sparkSession.sparkContext.broadcast((t, None))
    shards = max(1, -(-n_ids // SHARD_IDS))
    dealt = train.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard"), "doc_id", "ids")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids").select("shard", "ids")

    def run(batches):
        own, tables_ = subwords(path, ranks), shared.value[0]
        shard = trainer = None
        held: list[np.ndarray] = []
        total, windows, done = 0, 0, 0

        def take():
            if held:
                size = np.array([len(x) for x in held])
                ids, row_to = np.concatenate(held).astype(np.int64), np.cumsum(size)
                trainer.take(ids, _shifted(ids, row_to - size, own.end), *window_places(row_to - size, row_to))
                held.clear()

        def added():
            take()
            return total + np.rint(pack(trainer.w) * _UNIT).astype(np.int64) * trainer.n, windows + trainer.n, done + 1

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), windows))], names=made.fieldNames())

        for b in batches:
            values, at = _values(b.column(1))
            for i, now in enumerate(b.column(0).to_numpy().tolist()):
                if now != shard:
                    if trainer is not None:
                        total, windows, done = added()
                        if done == _SUMMED:
                            yield rows()
                            total, windows, done = 0, 0, 0
                    shard, trainer, waiting = now, Trainer(tables_), 0
                held.append(values[at[i] : at[i + 1]])
                waiting += len(held[-1])
                if waiting >= SHARD_IDS:
                    take()
                    waiting = 0
        if trainer is not None:
            total, windows, done = added()
            yield rows()

    each = dealt.transform(map_batches, run, made).groupBy("place").agg(F.sum(F.col("weighted").cast("decimal(38,0)")).alias("weighted"), F.sum("windows").alias("windows")).orderBy("place").collect()
    if not each:
        return start_weights() | {k: np.zeros(_SHAPES[k], np.float32) for k in ("out", "bias")}
    return unpack(np.array([int(r["weighted"]) / (r["windows"] * _UNIT) for r in each]))


@dataclass(frozen=True)
class Frequent:
    """The most frequent words, by hash, with counts; and the totals of all words."""

    words: Lookup
    counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def share(self) -> float:
        return WORD_SHARE if self.tokens else 0.0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts; -1 for a word that is not among them."""
        place = self.words.find(h)
        return np.where(place >= 0, np.append(self.counts, -1)[place], -1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def frequent_words(counts: DataFrame, most: int = WORDS) -> Frequent:
    tokens, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    least = _least_count(counts, most)
    top = counts.where(F.col("count") >= least).toPandas()
    h, c = top["word"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return Frequent(Lookup(h[order]), c[order], int(tokens), int(distinct))


def _least_count(counts: DataFrame, most: int) -> int:
    """A count that ``most`` rows at most reach, as small as bins of 1/64 of a power of two tell."""
    bins = counts.groupBy(F.floor(F.log2("count") * 64).alias("bin")).agg(F.count("*").alias("rows"), F.min("count").alias("low"), F.max("count").alias("high"))
    kept = 0
    for r in bins.orderBy(F.desc("bin")).collect():
        kept += r["rows"]
        if kept > most:
            return r["high"] + 1
    return 1


#: Counts of frequent words are kept beside the ids on a log scale, in steps of 1/2048, rounded down: shares of all words sum to 1 at most.
_STEP = 2048.0


def _blobs(values: np.ndarray, at: np.ndarray, kind: str = "<u2") -> pa.Array:
    """values[at[i]:at[i+1]] of every row as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((np.dtype(kind).itemsize * at).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _values(blobs: pa.Array, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """(values, begin of each row and the end) of a column that ``_blobs`` made."""
    at = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = blobs.buffers()[2] if at[-1] > at[0] else b""
    return np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0] if at[-1] > at[0] else 0), (at - at[0]) // size


def rest_of_memory(tokens: DataFrame, runs: DataFrame, words: DataFrame, memory: Memory, smooth: float, path: str, ranks: int, shared) -> DataFrame:
    """row, rare_known, rare_base, places, seen: counts of what no task holds, by its place in the row.

    A place is that of an id (its run) or, as -1 - unit, that of a word.
    """
    made = StructType([StructField("row", LongType()), StructField("place", IntegerType()), StructField("key", LongType())])

    def runs_of(batches):
        own, memory = subwords(path, ranks), shared.value[1]
        for b in batches:
            row, done = b.column(0).to_numpy(), 0
            for ids, row_from, row_to in _id_slices([b], 1):
                code = _codes(ids, _shifted(ids, row_from, own.end), row_from, own)
                other = np.flatnonzero(memory.counts(code) == 0)
                of = np.searchsorted(row_from, other, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(row[done + of]), pa.array((other - row_from[of]).astype(np.int32)), pa.array(code[other])], names=made.fieldNames())
                done += len(row_from)

    def words_of(batches):
        for b in batches:
            place, at = _values(b.column(1), "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), np.diff(at))), pa.array(-1 - place), pa.array(_values(b.column(2), "<i8")[0])], names=made.fieldNames())

    repeated = runs.where(f"count between 2 and {int(memory.count.min()) - 1 if len(memory.count) else 1 << 62}")
    of_runs = tokens.select("row", "ids").transform(map_batches, runs_of, made).join(repeated.withColumnRenamed("code", "key"), "key").select("row", "place", "count", F.lit(0).alias("known"), F.lit(0.0).alias("base"))
    count = F.coalesce("count", F.lit(0))
    of_words = (
        tokens.select("row", "rare_at", "rare").transform(map_batches, words_of, made).join(words.withColumnRenamed("word", "key"), "key", "left")
        .select("row", "place", count.alias("count"), (count > 0).cast("int").alias("known"), F.log10((count + 0.5) / smooth).alias("base"))
    )
    # words that training texts do not have add to the base figure only
    entry = F.when(F.col("count") > 0, F.struct("place", "count"))
    found = of_runs.unionByName(of_words).groupBy("row").agg(F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.collect_list(entry).alias("found"))
    return found.select("row", "rare_known", "rare_base", F.col("found.place").alias("places"), F.col("found.count").alias("seen"))


def tokenized(source: DataFrame, top: Frequent, path: str, ranks: int) -> DataFrame:
    """Each row's ids (unsigned 16-bit), its units' counts on a log scale (0: not a frequent word), the units and hashes of its other words, and the figures of its frequent words."""
    shared = source.sparkSession.sparkContext.broadcast(top)
    made = StructType(
        [source.schema[c] for c in ("row", "doc_id", "held_out")] + [StructField(c, LongType()) for c in ("n_tokens", "top_known")]
        + [StructField("top_base", DoubleType()), *(StructField(c, BinaryType()) for c in ("ids", "counts", "rare_at", "rare"))]
    )

    def run(batches):
        own, top = subwords(path, ranks), shared.value
        for b in batches:
            for first, end, words in kernel.word_slices(b.column(3), lower=True):
                ids, unit_at, row_at, hashes = own.sequence(words)
                count = top.find(hashes)
                known = count > 0
                sums = lambda v: np.add.reduceat(v, row_at[:-1])
                figures = [np.diff(row_at), sums(known.astype(np.int64)), sums(np.where(known, top.base(np.maximum(count, 0)), 0.0))]
                scale = np.where(known, np.floor(np.log(np.maximum(count, 1)) * _STEP) + 1, 0)
                other = np.flatnonzero(~known)
                other_at = np.searchsorted(other, row_at)
                place = other - np.repeat(row_at[:-1], np.diff(other_at))
                blobs = [_blobs(*b) for b in ((ids, np.append(unit_at, len(ids))[row_at]), (scale, row_at), (place, other_at, "<i4"), (hashes[other], other_at, "<u8"))]
                carried = [b.column(i).slice(first, end - first) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*carried, *(pa.array(f) for f in figures), *blobs], names=made.fieldNames())

    return source.transform(map_batches, run, made)


def model_scores(tokens: DataFrame, w: dict[str, np.ndarray], top: Frequent, path: str, ranks: int, shared) -> DataFrame:
    """``tokens``, with the columns of ``rest_of_memory``, without ids and places, with ``score``."""
    share, total = top.share, float(max(top.tokens, 1))
    carried = ["doc_id", "held_out", "n_tokens", "top_known", "top_base", "rare_known", "rare_base"]
    made = StructType([tokens.schema[c] for c in carried] + [StructField("score", DoubleType())])

    def run(batches):
        own = subwords(path, ranks)
        t, memory = shared.value
        scorer = Scorer.of(w, t)
        for b in batches:
            scores = []
            counts, _ = _values(b.column(8))
            found_at = np.r_[0, np.cumsum(b.column(9).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            places, seen = (b.column(i).flatten().to_numpy() for i in (9, 10))
            done = rows = 0
            for ids, row_from, row_to in _id_slices([b], 7):
                shifted = _shifted(ids, row_from, own.end)
                first, low, high = window_places(row_from, row_to)
                log_p, begin = np.zeros(len(ids)), np.ones(len(ids), np.float32)
                for i in range(0, len(first), 256):
                    s = slice(i, i + 256)
                    x = batch(ids, shifted, first[s], low[s], high[s])
                    place = x.place[x.scored]
                    log_p[place], begin[place] = (v[x.scored] for v in scorer.scores(x))
                unit_at = np.flatnonzero(own.begins[ids])
                unit_from = np.searchsorted(unit_at, row_from)
                at = found_at[rows : rows + len(row_from) + 1]
                place, n = places[at[0] : at[-1]], seen[at[0] : at[-1]]
                of = np.repeat(np.arange(len(row_from)), np.diff(at))
                rows += len(row_from)
                run_, word = place >= 0, place < 0
                code = _codes(ids, shifted, row_from, own)
                count = memory.counts(code)
                count[row_from[of[run_]] + place[run_]] = n[run_]
                log_p = memory.mixed(code, count, log_p)
                before = memory.log_begin(code[unit_at], begin[unit_at])
                after = np.append(before[1:], 0.0)
                after[ids[unit_at] == own.end] = 0.0
                of_unit = np.add.reduceat(log_p, unit_at) + after - before
                scale = counts[done : done + len(unit_at)].astype(np.float64)
                done += len(unit_at)
                own_count = np.where(scale > 0, np.exp((scale - 1) / _STEP), 0.0)
                own_count[unit_from[of[word]] - 1 - place[word]] = n[word]
                mixed = np.where(own_count > 0, np.log(np.maximum(share / total * own_count + (1 - share) * np.exp(of_unit), 1e-300)), np.log1p(-share) + of_unit)
                scores.append(np.add.reduceat(mixed, unit_from) / np.log(10))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=made.fieldNames())

    return tokens.select(*carried, "ids", "counts", "places", "seen").transform(map_batches, run, made)


def score(docs: DataFrame, path: str, ranks: int = RANKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    source = _source(docs)
    counts = stored(word_counts(source.where(~F.col("held_out"))))
    top = frequent_words(counts)
    tokens = stored(tokenized(source, top, path, ranks), "zstd")  # ids have no repeats that snappy finds, but few values
    train = tokens.where(~F.col("held_out"))
    runs = stored(run_counts(train, path, ranks))
    begins = subwords(path, ranks).begins
    pairs, memory = pairs_and_memory(runs, begins)
    t = tables(pairs, begins)
    shared = docs.sparkSession.sparkContext.broadcast((t, memory))
    w = fit_attention(train, t, path, ranks, int(pairs.sum()), shared)
    release(docs.sparkSession)
    rest = rest_of_memory(tokens, runs, counts, memory, top.tokens + 0.5 * (top.distinct + 1), path, ranks, shared)
    scored = model_scores(tokens.join(rest, "row", "left"), w, top, path, ranks, shared)
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(top.tokens).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
