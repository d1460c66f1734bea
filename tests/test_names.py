"""Names from a table: both ways against brute force, at 100,000 names, and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import names

ROWS = [
    ("Ann", "PERSON", 0.9), ("Ann Lee", "PERSON", 0.7), ("Lee Co", "COMPANY", 0.8), ("Lee", "PERSON", 0.6), ("Bo", "PERSON", 0.59),
    ("(C) Lee", "COMPANY", 1.0), ("Öz 3", "PERSON", 0.9), ("Ann", "COMPANY", 0.9), ("x", "PERSON", 0.6), ("", "PERSON", 1.0), (None, "PERSON", 1.0),
]


def brute(text, rows, threshold=names.THRESHOLD):
    best = {}
    for name, label, score in rows:
        if name and score >= threshold:
            best[name] = min(best.get(name, (0, "~")), (-score, label))
    out, at = [], 0
    while at < len(text or ""):
        fits = [n for n in best if text.startswith(n, at) and not (at and text[at - 1].isalnum()) and not text[at + len(n) : at + len(n) + 1].isalnum()]
        if fits:
            name = max(fits, key=len)
            out.append((at + 1, best[name][1], name, -best[name][0]))
            at += len(name)
        else:
            at += 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "name string, label string, score double")


WAYS = [{}, {"most_bytes": 0}, {"most_bytes": 0, "most_keys": 1}]


@pytest.mark.parametrize("way", WAYS)
def test_all_ways_are_brute_force(spark, way):
    rng = random.Random(5)
    pieces = ["Ann", "Lee", "Co", "Bo", "(C)", "Öz", "3", "x", " ", " ", " ", "_", "é", "\n", "😀", "."]
    texts = ["Ann Lee Co", "Ann Lee Cob", "xAnn Lee", "(C) Lee Co", "", None, "Öz 3 Öz 33", "Ann Lee Co"] + ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame([(i // 2, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = sorted((r.doc_id, r.text or "", [tuple(e) for e in r.found]) for r in names.detect(docs, table(spark, ROWS), **way).collect())
    assert got == sorted((i // 2, t or "", brute(t, ROWS)) for i, t in enumerate(texts))


@pytest.mark.parametrize("way", WAYS)
def test_empty_tables(spark, way):
    none = table(spark, [])
    docs = spark.createDataFrame([(1, "Ann")], "doc_id long, text string")
    assert [r.found for r in names.detect(docs, none, **way).collect()] == [[]]
    assert names.detect(docs.limit(0), table(spark, ROWS), **way).count() == 0


@pytest.mark.parametrize("way", WAYS[:2])
def test_a_hundred_thousand_names_and_a_long_text(spark, way):
    rows = [(f"n{i % 5000} s{i}", "PERSON", 0.8) for i in range(100_000)]
    said = [(17 * i) % 120_000 for i in range(20_000)]
    text = " ".join(f"n{i % 5000} s{i}" for i in said)
    docs = spark.createDataFrame([(0, text), (1, "n1 s2, n2 s2")], "doc_id long, text string")
    got = {r.doc_id: [e.value for e in r.found] for r in names.detect(docs, table(spark, rows), **way).collect()}
    assert got == {0: [f"n{i % 5000} s{i}" for i in said if i < 100_000], 1: ["n2 s2"]}


def test_masks_and_restores(spark):
    docs = spark.createDataFrame([(1, "Ann Lee of Lee Co wrote to a@b.org; Ann Lee"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in names.mask_documents(docs, table(spark, ROWS)).orderBy("doc_id").collect()}
    assert got[1].masked == "[PERSON_1] of [COMPANY_1] wrote to [EMAIL_1]; [PERSON_1]" and got[1].restored == "Ann Lee of Lee Co wrote to a@b.org; Ann Lee"
    assert got[2].masked is None


def test_each_name_once(spark):
    docs = spark.createDataFrame([(1, "Ann, Ann, Lee")], "doc_id long, text string")
    got = names.detect(docs, table(spark, ROWS), once=True).select(F.transform("found", lambda e: e["pos"])).first()[0]
    assert got == [1, 11]
