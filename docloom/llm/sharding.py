"""Sharding by a hypergeometric communication matrix.

Rows are put into shards of exact sizes (counts at most one apart) as a uniform
shuffle would put them: the rows are dealt to groups by a hash of all their columns
and, of rows that are equal in all, of a number (``numbered``); the
matrix says how many rows of each group go to each shard, drawn so that row sums
are the groups' sizes and column sums the shards' (a multivariate hypergeometric
draw for one group after the other); each group is permuted locally and cut by
its row of the matrix; the rows are exchanged; and each shard is permuted again.

The second permutation is a random order of the shard's rows, cut into ranges
of equal width of a 64-bit hash, so a shard is never sorted by one task: rows are
ranked inside a range and a range begins where the counts of those before it end.

Permutations are orders by a hash of (seed, row, number), so a lost task that is run
again gives the same rows; a new seed gives a new shuffle.  Only columns that the
caller asks for are shuffled.

Defined cases: an empty table gives no rows; rows of one key, or equal in all
columns, are dealt and permuted like any others, so many of them are no hot group and
not neighbours; a null key is a key like any other.  Columns must be of types that
Spark can group by.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SHARDS = 8
SEED = 20_240_229
#: Rows of a group or range, about: what one task sorts at a time.
GROUP_ROWS = 50_000
#: Most copies of one row that one task makes again from their number.
COPIES = 10_000
#: Largest population that numpy's exact sampler takes.
_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of good + bad, for any sizes.

    Beyond numpy's limit: inversion over the values within 40 standard deviations
    of the mean, outside of which the probability is below 1e-300.
    """
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    low = max(0, drawn - bad, int(mean - 40 * spread - 10))
    high = min(drawn, good, int(mean + 40 * spread + 10))
    # ratio of neighbours: p(k+1) / p(k) = (good-k)(drawn-k) / ((k+1)(bad-drawn+k+1))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """matrix[group, shard]: row sums are ``sizes``, column sums at most one apart (the first shards get the rest)."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(sizes), shards), np.int64)
    for g, size in enumerate(sizes):
        left, places = size, sum(room)
        for s in range(shards):
            places -= room[s]
            got = hypergeometric(rng, room[s], places, left) if places else left
            matrix[g, s] = got
            room[s] -= got
            left -= got
    return matrix


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each of several rows that are equal in all columns: 0, 1, ... .

    Equal rows are counted, which Spark does within tasks first, and made again from
    their count, in blocks that are dealt anew so that no task makes all of them.
    """
    every = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*every).agg(F.count("*").alias("__copies"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES).cast("long"))))
    blocks = blocks.repartition(F.xxhash64(*every, "__block"))
    last = F.least(F.col("__copies"), F.col("__block") + COPIES) - 1
    return blocks.select(*every, F.explode(F.sequence("__block", last)).alias(name))


def shuffle_into_shards(df: DataFrame, key: str, shards: int = SHARDS, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    key: the column that is hashed first, before all others.
    All columns of ``df`` are carried through two shuffles: select those that
    are needed.  Columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    sizes = df.groupBy().count().first()[0]
    n_groups = max(1, -(-sizes // group_rows))
    whole = [F.col(f"`{c}`") for c in [key, *(c for c in df.columns if c != key), "__copy"]]
    hashed = numbered(df, "__copy").withColumns({"__group": F.pmod(F.xxhash64(F.lit(seed), *whole), F.lit(n_groups)).cast("int"), "__order": F.xxhash64(F.lit(seed + 1), *whole)})
    counts = {r["__group"]: r["count"] for r in hashed.groupBy("__group").count().collect()}
    # one row for each 50,000 rows of the table; a table like any other, Spark broadcasts it only while it is small
    cuts = communication_matrix([counts.get(g, 0) for g in range(n_groups)], shards, seed).cumsum(axis=1)
    dealt = spark.createDataFrame([(g, [int(x) for x in c]) for g, c in enumerate(cuts)], "__group int, __cuts array<bigint>")

    others = [F.col(f"`{c}`") for c in df.columns]
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__order", *whole))
    shard = F.size(F.filter("__cuts", lambda c: c < F.col("__place"))).cast("int")
    sent = hashed.withColumn("__place", place).join(dealt, "__group").withColumn("shard", shard)

    per_shard = max(1, -(-sizes // (shards * group_rows)))
    again = F.xxhash64(F.lit(seed + 2), *whole)
    width = F.shiftrightunsigned(again, 33)  # 31 bits
    ranged = sent.select(*others, "shard", again.alias("__again"), F.floor(width * per_shard / F.lit(1 << 31)).cast("int").alias("__range"), width.alias("__width"))
    ranged = cut(ranged)
    before = ranged.groupBy("shard", "__range").count().withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__range")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__width", "__again", *others)) - 1
    return ranged.withColumn("__rank", rank).join(before, ["shard", "__range"]).select(*others, "shard", (F.col("__before") + F.col("__rank")).cast("long").alias("slot"))
