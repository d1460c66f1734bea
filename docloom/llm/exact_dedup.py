"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical (after ``normalise``, if one is given); of
equal texts the row with the largest id stays.  Three combinations find it, each
grouped by the digest *and* the whole text, so that no result rests on a digest:

1. each task deduplicates its own rows (the partial side of the first aggregation);
2. what tasks send is merged in groups of (digest, salt, text); the salt is the
   task's number, so the copies of a text held by all tasks go to ``salts`` places;
3. the salt winners, at most ``salts`` for a text, are combined for good.

Rows meet their winner again by digest alone where the combination has seen one
text under it, and by digest and text elsewhere.  Texts with a thousandth of all
rows or more, of which there can be a thousand, are joined by broadcast; so no key
of the shuffled join holds more than a thousandth of the rows.  Rows are narrow
there (id and digest): texts are exchanged only after the local deduplication.

Defined cases: a null text counts as empty; a null id is smaller than any other;
rows that repeat both text and id count each in ``group_size``, give a result row
each, and of those with the id that stays one is kept; an empty table gives no rows;
columns other than id and text are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Groups with more than one in so many of all rows are hot; there are at most so many of them.
HOT_SHARE = 1000
#: Copies of a row that are written out at a time.
BLOCK = 1 << 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise, digest) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", digest(F.col("text")).alias("digest"))


def combined(keyed: DataFrame, salts: int | None = None) -> DataFrame:
    """digest, text, keep_id, group_size: a row for each text of ``keyed`` (doc_id, text, digest), clustered by digest."""
    n = salts or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(n)))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256, salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: a row for each row of ``docs``.

    digest: selects what is compared, and does not decide; any string column of
    the (normalised) text will do.
    """
    keyed = _keyed(docs, id_col, text_col, normalise, digest)
    texts = combined(keyed, salts)
    heads = stored(texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    total, most = heads.agg(F.sum("group_size"), F.max("texts")).first()
    is_hot = F.col("group_size") * HOT_SHARE >= F.lit(total or 0)
    single = heads.where("texts = 1").drop("texts")
    rows = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    hot = F.broadcast(single.where(is_hot))  # at most HOT_SHARE rows
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(single.where(~is_hot), "digest"))
    if (most or 0) > 1:  # different texts under one digest
        shared = heads.where("texts > 1").select("digest")
        alike = keyed.join(shared, "digest", "left_semi").groupBy("digest", "text", "doc_id").agg(F.count("*").alias("n"))
        found = found.unionByName(alike.join(texts.join(shared, "digest", "left_semi"), ["digest", "text"]).select(found.columns))
    blocks = found.withColumn("first", F.explode(F.expr(f"sequence(1L, n, {BLOCK}L)")))
    each = blocks.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + (BLOCK - 1)))))
    return each.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text.

    The winner's columns are carried through the same three combinations.
    """
    n = salts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    # the id comes first in the order, and a row with no id has one smaller than all
    own = docs.select(whole, F.struct(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`")).alias("order"), key.alias("text"))
    own = own.withColumns({"digest": sha256(F.col("text")), "salt": F.pmod(F.spark_partition_id(), F.lit(n))})
    best = [F.max_by("row", "order").alias("row"), F.max("order").alias("order")]
    return own.groupBy("digest", "salt", "text").agg(*best).groupBy("digest", "text").agg(best[0]).select("row.*")
