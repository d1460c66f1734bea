"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding follows the rank file: a text is split by a pattern, a piece that is a
token is that token, and every other piece is merged by lowest rank first, the
leftmost of equals.  The merges are compiled to a finite-state transducer that
reads a piece byte by byte:

* the tokens are a trie, and each token that merging can make has the two halves
  of its last merge; two tokens can stand side by side when no piece on the
  right edge of the first ever merges with one on the left edge of the second
  (``Transducer.may_follow``), and a sequence is the encoding of its bytes when
  each of its tokens can be made and each neighbouring pair can stand so;
* so the encoding of a prefix ends with the one token that may follow the
  encoding of what stands before it.  A state holds the trie nodes of tokens that
  are still open, each with the tokens before it that are not yet certain;
  tokens that all of them share are emitted at once.  Lookahead is bounded by the
  longest token.

States are made when first met and kept in a table; the table and the memo of
pieces are emptied when they reach their bounds, which changes no result.

Decoding joins token bytes chunk by chunk and turns them into text with an
incremental UTF-8 machine that holds back an unfinished character.

Defined cases: a null or empty text has no tokens; ids outside the vocabulary
raise KeyError; undecodable bytes become U+FFFD in text, and stay in the bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import with_text_columns

#: Bounds of what a Python worker remembers: some 250 MB of pieces, 150 MB of states.
#: They cost or save time only; a job whose executors have little memory beside the heap passes less.
MAX_STATES = 150_000
MAX_PIECES = 1_000_000
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[bytes]:
    """Merges of rank under ``below``, lowest rank first, leftmost of equals: the definition that the transducer follows."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], _NEVER)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        #: edges of each token: (piece, rank at which it is merged away) from the byte to the whole token
        self.left_edge: dict[int, list[tuple[bytes, int]]] = {}
        self.right_edge: dict[int, list[tuple[bytes, int]]] = {}
        #: trie: children by byte, and the token that ends in each node
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(text) == 1:
                left = right = []
            else:
                halves = merge(text, ranks, rank)
                if len(halves) != 2 or any(ranks[h] not in self.left_edge for h in halves):
                    continue  # merging can't make it: a token only where it is a whole piece
                left = [*self.left_edge[ranks[halves[0]]][:-1], (halves[0], rank)]
                right = [*self.right_edge[ranks[halves[1]]][:-1], (halves[1], rank)]
            self.left_edge[rank] = [*left, (text, _NEVER)]
            self.right_edge[rank] = [*right, (text, _NEVER)]
            node = 0
            for byte in text:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][byte]
            self.token[node] = rank
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def may_follow(self, first: int, second: int) -> bool:
        """Whether first, second is the encoding of their bytes.

        Pieces p on the right edge of first and q on the left edge of second are
        neighbours while neither is merged away; p q merges in that time if its
        rank is under that at which p goes (at equal rank the left merge is
        first) and not over that at which q goes.
        """
        known = self._pairs.get((first, second))
        if known is None:
            ps, qs, i, j, known = self.right_edge[first], self.left_edge[second], 0, 0, True
            while True:
                (p, p_until), (q, q_until) = ps[i], qs[j]
                r = self.ranks.get(p + q, _NEVER)
                if r < _NEVER and r < p_until and r <= q_until:
                    known = False
                    break
                if p_until == q_until == _NEVER:
                    break
                if p_until <= q_until:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) > 4 * self.max_states:
                self._pairs.clear()
            self._pairs[first, second] = known
        return known

    # A state: (last token emitted or -1, ((trie node, tokens not yet emitted), ...)); the root is the last item.
    def _reset(self) -> None:
        start = (-1, ((0, ()),))
        self._ids = {start: 0}
        self._states = [start]
        self._moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]

    def _move(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        emitted, items = self._states[state]
        child, tokens, pairs = self.child, self.token, self._pairs
        grown, whole = [], None
        for node, chain in items:
            to = child[node].get(byte)
            if to is None:
                continue
            if whole is None and (token := tokens[to]) >= 0:
                last = chain[-1] if chain else emitted
                if last < 0 or (pairs[last, token] if (last, token) in pairs else self.may_follow(last, token)):
                    whole = (*chain, token)
            if child[to]:
                grown.append((to, chain))
        out = whole
        for _, chain in grown:  # what all of them begin with
            if not chain:
                out = ()
                break
            while chain[: len(out)] != out:
                out = out[:-1]
        if out:
            k = len(out)
            new = (out[-1], (*[(n, c[k:]) for n, c in grown], (0, whole[k:])))
        else:  # the last emitted token matters only to a token that starts right behind it
            new = (emitted if any([not c for _, c in grown]) else 0, (*grown, (0, whole)))
        to = self._ids.get(new)
        if to is None:
            to = self._ids[new] = len(self._states)
            self._states.append(new)
            self._moves.append({})
        move = self._moves[state][byte] = (out, to)
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        moves, state, out = self._moves, 0, []
        for byte in piece:
            made, state = moves[state].get(byte) or self._move(state, byte)
            out += made
        out += self._states[state][1][-1][1]
        return out


class _Pieces(dict):
    """Ids of each piece as little-endian unsigned 32-bit bytes, made when first met."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = np.array(self.transducer.encode_piece(piece.encode()), "<u4").tobytes()
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES):
        ranks = read_ranks(path)
        # the rank file's library takes white space as Unicode's property, which this module's \s is not
        self._split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._pieces = _Pieces(Transducer(ranks, max_states), max_pieces)
        self.table = {i: t for t, i in ranks.items()}
        self.first_unused = max(self.table) + 1

    def packed(self, text: str) -> bytes:
        pieces = self._pieces
        return b"".join([pieces[p] for p in self._split(text)])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


class Utf8Machine:
    """Incremental UTF-8: feed() gives the text whose characters are complete, finish() the rest."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue  # a continuation byte; its lead stands before
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if back >= need:
                return 0
            if back > 1:  # the second byte is restricted after some leads
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[len(data) - back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def decode_stream(ids: Iterable[np.ndarray], table: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of id chunks, as soon as its characters are complete."""
    machine, token = Utf8Machine(), table.__getitem__
    for chunk in ids:
        yield machine.feed(b"".join(map(token, chunk.tolist())))
    yield machine.finish()


def chunks(ids: np.ndarray, size: int = 8192) -> Iterator[np.ndarray]:
    for a in range(0, len(ids), size):
        yield ids[a : a + size]


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Keeps the garbage collector from walking through the tables again and again; they hold no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> Encoder:
    """One for each Python worker: built once, used for all its tasks."""
    return Encoder(path, pattern, max_pieces, max_states)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``; path: a rank file at the same place on every executor."""
    made = StructType([StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def fn(texts: pa.Array) -> list[pa.Array]:
        own = encoder(path, pattern, max_pieces, max_states)
        with _no_cycles():
            packed = [own.packed(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        ids = np.frombuffer(b"".join(packed), "<i4")
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(np.diff(ends), pa.int64())]

    return with_text_columns(docs, "text", made, fn, keep, after=encoder.cache_clear)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256: encodes each text and decodes its ids as a stream."""
    made = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def fn(texts: pa.Array) -> list[pa.Array]:
        own = encoder(path, pattern)
        sizes, of_ids, of_text = [], [], []
        with _no_cycles():
            for value in texts:
                packed = own.packed(value.as_py() or "")
                back = hashlib.sha256()
                for part in decode_stream(chunks(np.frombuffer(packed, "<u4")), own.table):
                    back.update(part.encode())
                sizes.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(back.hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return with_text_columns(docs, "text", made, fn, keep)
