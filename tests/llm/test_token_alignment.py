"""Token alignment against whole-text encoding, per-byte groups and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import kernel, token_alignment

from .helpers import AWKWARD, documents, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        """Both lists of (id, bytes), of a text that both spell."""
        if not text:
            return [], []
        in_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        in_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        spelled = (" " + text).encode()
        return (in_a, in_b) if b"".join(x for _, x in in_a) == spelled == b"".join(x for _, x in in_b) else ([], [])

    return tokens


def grouped(in_a, in_b):
    ends = []
    for tokens in (in_a, in_b):
        at, found = 0, []
        for _, x in tokens:
            at += len(x)
            found.append(at)
        ends.append(found)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for cut in cuts:
        p, q = i, j
        while i < len(ends[0]) and ends[0][i] <= cut:
            i += 1
        while j < len(ends[1]) and ends[1][j] <= cut:
            j += 1
        out.append(([t for t, _ in in_a[p:i]], [t for t, _ in in_b[q:j]]))
    return out


def brute(rows, tokens):
    made, held = [], Counter()
    for doc, text in rows:
        in_a, in_b = tokens(text)
        groups = grouped(in_a, in_b)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        held.update(links.keys())
        made.append((doc, in_a, in_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc, in_a, in_b, groups, links in made:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        n_best = sum(n for (x, y), n in links.items() if held[x, y] == best[x])
        out[doc, len(in_a), len(in_b), len(groups), sum(links.values()), n_best, sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if in_a else ""] += 1
    return out


def aligned(df, **options):
    return Counter(tuple(r[c] for c in COLUMNS) for r in token_alignment.align(df, A, B, **options).collect())


SPACES = [" ", "  ", "   ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "▁", "​", "﻿", "\0"]
WORDS = ["a", "the", "Alignment", "über", "naïve", "слово", "漢字", "かな", "한글", "😀", "é", "ﬁ", "don't", "'s", "x_y", "12,000", "1234567", "...", "--", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "http://a.b/c?d=e", "zzzzqqqq", "ÀÀÀ"]


def test_real_texts_with_and_without_rare_pairs(spark, whole):
    docs = documents(spark)
    expected = brute([tuple(r) for r in docs.collect()], whole)
    assert aligned(docs) == expected and sum(expected.values()) == 200
    assert aligned(docs, hot=60) == expected  # most pairs are joined
    assert aligned(docs, hot=1) == expected


def test_odd_texts(spark, whole):
    r = random.Random(3)
    rows = list(AWKWARD) + [(100, "a "), (101, " a"), (102, "  "), (103, " "), (104, "a  b"), (105, " a  b "), (106, "▁a"), (107, "a　 b"), (108, "a　  b"), (109, "a 　b"), (110, "x\n  y \n z"), (111, "a\xa0 \xa0 b")]
    for i in range(400):
        spaces = r.choice([[" "], [" ", "  "], SPACES])
        rows.append((1000 + i, "".join(r.choice(WORDS) + r.choice(spaces + ["", " "]) for _ in range(r.randrange(1, 40)))))
    rows += [rows[-1], (None, "no id"), (None, "no id"), (1000, "two texts of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "rare": F.lit(1)})
    expected = brute(rows, whole)
    assert sum(n for k, n in expected.items() if k[1]) > 300
    assert aligned(df) == expected
    assert aligned(df, hot=20) == expected


def test_long_text_goes_by_parts(spark, whole, monkeypatch):
    r = random.Random(4)
    long = "".join(r.choice(WORDS[:19]) + r.choice([" ", " ", "  ", "\n", ""]) for _ in range(30_000))
    rows = [(1, long), (2, "short"), (3, "x" * 300_000), (4, " ".join(["word"] * 60_000) + " "), (5, None)]
    memo = token_alignment.Stretches(token_alignment.Tokenizers(A, B))
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(token_alignment, "PART", 5000)
    expected = {k[0]: k for k in brute(rows, whole)}
    column = pa.array([t for _, t in rows])
    data, offsets = kernel.text_buffer(column)
    for a, b in kernel.row_slices(offsets, 5000):
        part = token_alignment._Slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], memo)
        for i in range(a, b):
            own = part.row == i - a
            assert (*part.figures[i - a], part.digests[i - a]) == (*expected[rows[i][0]][1:5], expected[rows[i][0]][7])
            assert part.weight[own].sum() == part.figures[i - a, 3] and len(np.unique(part.pair[own])) == own.sum()


def test_stabbing():
    import numpy as np

    first, last = token_alignment.overlaps(np.array([2, 5, 6, 9]), np.array([1, 2, 6, 8, 9]))
    assert first.tolist() == [0, 2, 2, 3] and last.tolist() == [2, 3, 3, 5]
    assert token_alignment.boundaries(first, last).tolist() == [0, 1, 3]


def test_empty_table(spark):
    assert not aligned(empty(spark))
    assert aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")) == {(1, 0, 0, 0, 0, 0, 0, ""): 1}
