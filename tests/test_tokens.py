"""Tokens by the longest piece, and chunks that count them."""

import random

from docloom.functions.tokens import Vocabulary
from docloom.operators import structure

PIECES = ["a", "b", "ab", "abc", "abcd", "c", "d", "the", "cat", "ca", "t", "s"]


def brute(word, begins, inner):
    out, at, known = [], 0, begins
    while at < len(word):
        fits = [p for p in known if word.startswith(p, at)]
        if not fits:
            return [len(word)]
        at += max(map(len, fits))
        out.append(at)
        known = inner
    return out


def test_longest_piece():
    r = random.Random(1)
    vocabulary = Vocabulary(PIECES, PIECES[:6])
    words = ["".join(r.choice("abcdtsx") for _ in range(r.randrange(1, 12))) for _ in range(2000)]
    assert all(vocabulary.ends(w) == brute(w, PIECES, PIECES[:6]) for w in words * 2)
    assert vocabulary.count("The cats \n zzz") == 1 + 1 + 1 and vocabulary.count("") == 0
    for line in [" ".join(words[i : i + 40]) for i in range(0, 2000, 40)] + ["ab" * 500 + "  the   cat ", "the", "", "  "]:
        for most in (1, 7, 30):
            parts = vocabulary.pieces(line, most)
            assert all(n <= most for _, n in parts) and sum(n for _, n in parts) == vocabulary.count(line)
            assert "".join("".join(x for x, _ in parts).split()) == "".join(line.split())


def test_chunks_by_tokens(spark):
    r = random.Random(2)
    vocabulary = Vocabulary("abcdefgh0123456789#")
    text = "\n".join(["# One", "## Two"] + [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(r.choice([0, 3, 30, 200]))) for _ in range(25)] + ["# Last", "b" * 300 + " @@PAGE_9@@", "a @@PAGE_7@@"])
    out = structure.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 50, vocabulary).orderBy("chunk_no").collect()
    assert {c.doc_id for c in out} == {1} and all(c.n_tokens <= 50 for c in out)
    assert all(vocabulary.count(c.content) <= c.n_tokens for c in out)
    assert "".join("".join(c.content for c in out).split()) == "".join("".join(x for x in text.split("\n") if not x.startswith("#")).replace("@@PAGE_9@@", "").replace("@@PAGE_7@@", "").split())
    # neighbours of one heading are merged while they fit
    same = [(a, b) for a, b in zip(out, out[1:]) if a.structural_path == b.structural_path]
    assert all(a.n_tokens + vocabulary.count(b.content.split("\n")[0]) > 50 for a, b in same)
    assert [c.pages for c in out if c.pages] == [[7, 9]] and out[-1].page_number == 9
