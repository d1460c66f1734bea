"""Token counts by a vocabulary: the longest piece that fits, again and again, found in a trie.

A vocabulary has pieces that begin a word and pieces that go on with one, as in
word-piece models; the caller reads them from the model's file.  A word of which no
piece fits is one unknown token.  Counts of words are kept by each worker, as most words come again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.functions.ship import map_batches

PIECE = StructType([StructField("line", StringType()), StructField("n", IntegerType())])
#: Words whose pieces a worker keeps, and their longest.
MEMO, LONGEST = 200_000, 64
_WORD = re.compile(r"\S+")
_END = ""  # the key under which a node says that a piece ends there


def trie(pieces: Iterable[str]) -> dict:
    root: dict = {}
    for piece in pieces:
        node = root
        for char in piece:
            node = node.setdefault(char, {})
        node[_END] = True
    return root


class Vocabulary:
    """begins: pieces that stand at the begin of a word; inner: those that stand elsewhere (``begins``, if None)."""

    def __init__(self, begins: Iterable[str], inner: Iterable[str] | None = None, lower: bool = True):
        self.begins = trie(p for p in begins if p)
        self.inner = self.begins if inner is None else trie(p for p in inner if p)
        self.lower = lower
        self.memo: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def ends(self, word: str) -> list[int]:
        """Where each token of ``word`` ends, in characters."""
        found = self.memo.get(word)
        if found is None:
            found = self._ends(word)
            if len(word) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def _ends(self, word: str) -> list[int]:
        # a letter whose small form is longer stays as it is, so that places are those of the word
        text = "".join(c.lower() if len(c.lower()) == 1 else c for c in word) if self.lower else word
        out, at, node = [], 0, self.begins
        while at < len(text):
            best, here = 0, at
            while here < len(text) and text[here] in node:
                node = node[text[here]]
                here += 1
                if _END in node:
                    best = here
            if not best:
                return [len(word)]  # unknown as a whole
            out.append(best)
            at, node = best, self.inner
        return out

    def count(self, text: str) -> int:
        return sum(len(self.ends(w)) for w in _WORD.findall(text))

    def pieces(self, line: str, most: int) -> list[tuple[str, int]]:
        """(text, tokens) of a line, in parts of at most ``most`` tokens: cut between words, or in a word that has more."""
        spans = [(m.start(), m.end(), self.ends(m[0])) for m in _WORD.finditer(line)]
        if (n := sum(len(e) for _, _, e in spans)) <= most:
            return [(line, n)]
        out, first, last, held = [], 0, 0, 0
        for start, end, ends in spans:
            if held and held + len(ends) > most:
                out.append((line[first:last], held))
                held = 0
            while len(ends) > most:  # here nothing is held
                cut = start + ends[most - 1]
                out.append((line[start:cut], most))
                ends = [e - ends[most - 1] for e in ends[most:]]
                start = cut
            first, last, held = (start if not held else first), end, held + len(ends)
        return out + [(line[first:last], held)]


def with_pieces(docs: DataFrame, vocabulary: Vocabulary, most: int, name: str = "pieces") -> DataFrame:
    """``docs`` with the lines of ``text`` in pieces of at most ``most`` tokens; headings (``#``) stay whole; null for a null text."""
    docs = docs.drop(name)
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the size of a vocabulary
    out = StructType([*docs.schema.fields, StructField(name, ArrayType(PIECE))])
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("line", pa.string()), ("n", pa.int32())]))

    def run(batches):
        own = given.value
        for batch in batches:
            made = []
            for text in batch.column(at).to_pylist():
                if text is None:
                    made.append(None)
                    continue
                parts = [(line, own.count(line)) if line.startswith("#") else part for line in text.split("\n") for part in ([None] if line.startswith("#") else own.pieces(line, most))]
                made.append([{"line": x, "n": n} for x, n in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=out.fieldNames())

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), run, out)
