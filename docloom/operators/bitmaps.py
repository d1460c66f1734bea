"""Posting sets of attributes as bitmaps: who has all of some keys, without a look at the documents.

An attribute's value has a bitmap for each bucket of document ids in which it occurs;
an intersection joins bitmaps of one bucket, so it never needs more than a bucket in
one place, whatever the sets' sizes, and counts are counts of bits.  Sets of parts of
the documents are merged by the union of their bitmaps.

Defined cases: null and empty values are not indexed; rows without an id are left out;
an id that repeats is one member; without any key all indexed documents
are members; an unknown value has none.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap; fixed by Spark's functions.
BITS = 32768
#: The attribute under which all documents stand.
EVERY = ""


def posting_sets(docs: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute, value, bucket, bits; and, under EVERY, the documents that are there."""
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").cast("string").alias("value")) for a in attributes]
    every = F.struct(F.lit(EVERY).alias("attribute"), F.lit("all").alias("value"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(every, *pairs)).alias("a")).where("a.value <> ''")
    keyed = rows.select("a.attribute", "a.value", F.bitmap_bucket_number("doc_id").alias("bucket"), F.bitmap_bit_position("doc_id").alias("bit"))
    return keyed.groupBy("attribute", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(*sets: DataFrame) -> DataFrame:
    """The posting sets of several parts of the documents as one."""
    return functools.reduce(DataFrame.unionByName, sets).groupBy("attribute", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(sets: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """bucket, bits of the documents that have all the given values; keys without a value do not count."""
    keys = {a: v for a, v in wanted.items() if v} or {EVERY: "all"}
    chosen = functools.reduce(lambda x, y: x | y, [(F.col("attribute") == a) & (F.col("value") == v) for a, v in keys.items()])
    met = sets.where(chosen).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return met.where((F.col("n") == len(keys)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def cardinality(found: DataFrame) -> DataFrame:
    """n_docs: one row."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_docs"))


def members(found: DataFrame) -> DataFrame:
    """doc_id, one row for each bit that is set."""
    byte = F.conv(F.hex(F.expr("substring(bits, at + 1, 1)")), 16, 10).cast("int")
    each = found.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("at")).select("bucket", "at", byte.alias("byte")).where("byte <> 0")
    bits = each.select("bucket", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.expr("byte").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)).alias("i"))
    place = (F.col("at") * 8 + F.col("i")).cast("long")
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + place + 1).otherwise(F.col("bucket") * BITS - place).alias("doc_id"))


def pair_counts(sets: DataFrame, one: str, other: str) -> DataFrame:
    """first, second, n_docs: for each pair of values of two attributes that some document has."""
    named = lambda a, name: sets.where(F.col("attribute") == a).select("bucket", F.col("value").alias(name), F.col("bits").alias(f"{name}_bits"))
    met = named(one, "first").join(named(other, "second"), "bucket")
    both = met.select("first", "second", "bucket", F.explode(F.array("first_bits", "second_bits")).alias("bits")).groupBy("first", "second", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return both.groupBy("first", "second").agg(F.sum(F.bitmap_count("bits")).alias("n_docs")).where("n_docs > 0")
