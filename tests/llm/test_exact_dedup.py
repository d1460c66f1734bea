"""Exact deduplication against grouping in Python."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docloom.llm import exact_dedup

from .helpers import AWKWARD, awkward, empty

ROWS = list(AWKWARD) + [(i, "hot copy") for i in range(100, 900)] + [(900, "hot copy")] * 70 + [(None, "hot copy"), (None, "no id"), (None, "no id"), (50, "x" * 3_000_000), (51, "x" * 3_000_000), (52, "x" * 2_999_999 + "y"), (7, None), (8, "HOT copy")]


def brute(rows, key=lambda t: t):
    same = defaultdict(list)
    for doc, text in rows:
        same[key(text or "")].append(doc)
    out = Counter()
    for text, ids in same.items():
        most = max((i for i in ids if i is not None), default=None)
        for n, doc in enumerate(sorted(ids, key=lambda d: (d is None, d != most, d or 0))):
            first = n == 0 and (doc == most)
            out[doc, most, len(ids), first] += 1
    return out


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep_id": F.lit("clash"), "digest": F.lit(1), "salt": F.lit(None).cast("string")}).repartition(6)


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_copies(spark):
    assert found(exact_dedup.groups(table(spark))) == brute(ROWS)
    assert found(exact_dedup.groups(table(spark), salts=1)) == brute(ROWS)


def test_result_does_not_rest_on_the_digest(spark):
    weak = lambda text: F.substring(text, 1, 1)
    assert found(exact_dedup.groups(table(spark), digest=weak)) == brute(ROWS)
    assert found(exact_dedup.groups(table(spark), digest=lambda t: F.lit("all alike"))) == brute(ROWS)


def test_normalised(spark):
    got = exact_dedup.groups(table(spark), normalise=F.lower)
    assert found(got) == brute(ROWS, str.lower)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 16)
    assert found(exact_dedup.groups(table(spark))) == brute(ROWS)


def test_survivors(spark):
    got = exact_dedup.survivors(table(spark)).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter({(max((d for d, u in ROWS if (u or "") == t and d is not None), default=None), t): 1 for t in {u or "" for _, u in ROWS}})
    assert {r.keep_id for r in got} == {"clash"}


def test_empty_table(spark):
    assert not exact_dedup.groups(empty(spark)).collect() and not exact_dedup.survivors(empty(spark)).collect()
    assert found(exact_dedup.groups(awkward(spark, extra=True))) == brute(AWKWARD + [AWKWARD[6], AWKWARD[1]])
