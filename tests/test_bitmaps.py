"""Posting sets as bitmaps against sets."""

import itertools
import random

from docloom.operators import bitmaps

SCHEMA = "doc_id long, user string, kb string, doc string"


def test_any_subset_of_keys(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["u1", "u2", "", None]), r.choice(["k1", "k2"]), r.choice(["d1", None])) for i in [*range(-40, 200), *(r.randrange(10**7) for _ in range(500)), 32768, 32769, 65536]]
    rows += rows[:5] + [(None, "u1", "k1", "d1")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["user", "kb", "doc"]
    whole = bitmaps.posting_sets(docs, names)
    parts = bitmaps.merged(bitmaps.posting_sets(docs.where("doc_id % 2 = 0"), names), bitmaps.posting_sets(docs.where("doc_id % 2 <> 0"), names))
    for n, values in enumerate(itertools.product(["u1", None], ["k2", ""], ["d1", None])):
        wanted = dict(zip(names, values))
        expected = {row[0] for row in rows if row[0] is not None and all(not v or row[1 + i] == v for i, v in enumerate(values))}
        found = bitmaps.intersection(whole if n % 2 else parts, wanted)
        got = [x.doc_id for x in bitmaps.members(found).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
        assert bitmaps.cardinality(found).first().n_docs == len(expected)
    assert bitmaps.members(bitmaps.intersection(whole, {"user": "u1", "kb": "none"})).count() == 0
    ids = lambda i, v: {row[0] for row in rows if row[i] == v and row[0] is not None}
    counts = {(x.first, x.second): x.n_docs for x in bitmaps.pair_counts(whole, "user", "kb").collect()}
    assert counts == {(u, k): len(ids(1, u) & ids(2, k)) for u in ("u1", "u2") for k in ("k1", "k2")}


def test_no_documents(spark):
    sets = bitmaps.posting_sets(spark.createDataFrame([], SCHEMA), ["user"])
    assert bitmaps.cardinality(bitmaps.intersection(sets, {"user": "u"})).first().n_docs == 0 and bitmaps.members(bitmaps.intersection(sets, {})).count() == 0
