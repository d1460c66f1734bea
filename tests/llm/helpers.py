"""Brute-force readings of the operators' definitions, in plain Python."""

import re

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


#: Documents with every awkward case: null, empty, blank, short, repeated, long, odd characters.
AWKWARD = [
    (0, None), (1, ""), (2, " \t\n\x0b"), (3, "one"), (4, "one two"), (5, "é ü ñ 漢字 😀 " * 9), (6, "A b C " * 700), (7, "A b C " * 700),
    (8, "\n".join(f"line {i % 3} with some words in it" for i in range(60))), (9, "x" * 5000), (10, "a b a\x1cb   end"), (11, "one two"),
]


def awkward(spark, extra=False):
    rows = AWKWARD + [AWKWARD[6], AWKWARD[1]] if extra else AWKWARD
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
