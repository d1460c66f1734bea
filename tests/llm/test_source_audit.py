"""The audit against plain dictionaries, on odd rows; tries against sorted sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import source_audit, term_trie

from .helpers import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    seen, occurs = defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(docs):
        for t in TERM.findall(text):
            seen[lang, lower(t)].add(i)
            occurs[lang, source][lower(t)] += 1
    out = set()
    for lang in {d[1] for d in docs}:
        kept = sorted((t for (one, t), ids in seen.items() if one == lang and len(ids) >= least), key=lambda t: t.encode())
        sources = sorted({d[2] for d in docs if d[1] == lang}, key=lambda s: s.encode())
        counts = {s: [occurs[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 1_000_000_000 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        q = share([sum(c) for c in zip(*counts.values())])
        p = {s: share(c) for s, c in counts.items()}
        for s in sources:
            others = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(others)}
            terms = sorted((y - x, t.encode(), t) for t, x, y, n in zip(kept, p[s], q, counts[s]) if n and x > y)
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


def got(docs, least, top):
    rows = [tuple(r) for r in source_audit.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


WORDS = ["Zebra", "zebra", "über", "ÜBER", "漢字", "don't", "a1b", "É", "x" * 40, "K", "K", "tie", "eit", "sam", "same", "ſ", "😀", "á"]


def rows_of(n, seed):
    r = random.Random(seed)
    rows = [(" ".join(r.choices(WORDS, k=r.randrange(0, 30))), r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "ß", "", None])) for _ in range(n)]
    return rows + [(None, "xx", "only"), ("", "xx", "other"), ("few terms here", "yy", None), (WORDS[0] + " " + "long " * 300_000, "en", "s1")] + rows[:3] * 2


@pytest.mark.parametrize("least, top", [(1, 3), (12, 50), (1000, 5)])
def test_brute_force(spark, least, top, monkeypatch):
    rows = rows_of(150, least)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "n": F.lit("clash"), "groups": F.lit(1)}).repartition(5)
    expected = brute(rows, least, top)
    assert got(docs, least, top) == expected and expected
    if least == 1:
        monkeypatch.setattr(source_audit, "RANGE_TERMS", 3)
        monkeypatch.setattr(source_audit, "SOURCES", 2)
        monkeypatch.setattr(source_audit, "ENTRIES", 10)
        assert got(docs, least, top) == expected


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "text string, lang string, source string"), 30, 50) == set()


def test_shares_of_large_counts():
    counts = np.array([0, 7, 10**13, 2 * 10**14], np.int64)
    total = np.array([10**15] * 4, np.int64)
    assert source_audit.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // 10**15 for c in counts]


def test_trie_merges_in_any_order():
    r = random.Random(5)
    texts = [" ".join(r.choices(WORDS, k=9)) for _ in range(300)]
    group = [r.randrange(4) for _ in texts]
    n, documents = Counter(), Counter()
    for text, g in zip(texts, group):
        found = [lower(t).encode() for t in TERM.findall(text)]
        n.update((t, g) for t in found)
        documents.update((t, g) for t in set(found))
    for parts in (1, 7):
        trie = term_trie.Trie()
        for i in range(parts):
            trie.add_rows(pa.array(texts[i::parts]), np.array(group[i::parts]))
            trie.merge()
        terms, leaf, own, occurs, held = trie.merge()
        terms = terms.to_pylist()
        assert terms == sorted({t for t, _ in n})
        assert {(terms[i], g): (x, y) for i, g, x, y in zip(leaf, own, occurs, held)} == {k: (n[k], documents[k]) for k in n}
        assert term_trie.traverse(*term_trie.flatten(terms)) == terms
