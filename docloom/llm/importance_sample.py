"""Quality selection by importance resampling.

Texts are read as hashed n-grams (words and word pairs, A-Z lower-cased, repeats
counted).  Two generative models give the probability of a bucket: that of all texts
(raw) and that of target texts (labelled good and not toxic).  A text's log importance
is the sum over its n-grams of log(target / raw), and the sample is the ``k`` texts of
largest log importance / TEMPERATURE + Gumbel noise, which is drawing without
replacement in proportion to the weights (at a temperature of 1).

The target texts are among the raw ones, so a bucket's target count given its raw
count is a random thinning unless the bucket has to do with quality.  The target
model backs off to the raw one for buckets within Z standard deviations of that
thinning; otherwise the many accidental ratios of a long text outweigh the few
telling ones (README has figures).  ``z = 0`` gives the plain ratio of smoothed counts.

Counts are over all texts: every task counts its own in one array of BUCKETS
numbers, and arrays are added by bucket.  At most TARGETS labelled ids (those of
smallest hash) mark the target texts.  Noise is a function of the id, so a run
can be repeated; the k-th key is found exactly by counting keys in ever smaller
intervals, without sorting them in one place.

Defined cases: a null or empty text has log importance 0; without labels every
text has, and all are kept; equal keys are taken by the smallest id, rows without
one last, and rows with the same key and id are kept or left together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import kernel
from .shared import cut, map_batches, with_text_columns

BUCKETS = 1 << 20
TARGETS = 100_000
Z = 4.0
TEMPERATURE = 1.0
SEED = 7


def text_buckets(words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, how often), each pair once."""
    hashes = words.hashes()
    row = words.row_of_word()
    first, pairs = words.windows(hashes, 2)
    row = np.concatenate([row, row[first]])
    bucket = np.concatenate([hashes, pairs]) & np.uint64(BUCKETS - 1)
    key, count = np.unique(row.astype(np.uint64) * np.uint64(BUCKETS) + bucket, return_counts=True)
    return (key >> np.uint64(BUCKETS.bit_length() - 1)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), count


def log_ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, z: float = Z) -> np.ndarray:
    """log(probability in the target model / in the raw model), 0 where the target model backs off.

    raw, target: counts of buckets; n_raw, n_target: of all n-grams.
    """
    if not n_target or n_target >= n_raw:
        return np.zeros(len(raw))
    share = n_target / n_raw
    expected = raw * share
    told = np.abs(target - expected) > z * np.sqrt(raw * share * (1 - share))
    return np.where(told, np.log((target + 0.5) / (expected + 0.5)), 0.0)


def fit(docs: DataFrame, good_ids: np.ndarray, z: float = Z) -> np.ndarray:
    """The log ratio of every bucket, from all of ``docs`` (doc_id, text)."""
    made = StructType([StructField("bucket", IntegerType()), StructField("raw", LongType()), StructField("target", LongType())])
    good_ids = np.sort(good_ids)

    def run(batches):
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)  # the last bucket counts all
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            at = np.minimum(np.searchsorted(good_ids, ids), max(len(good_ids) - 1, 0))
            good = good_ids[at] == ids if len(good_ids) else np.zeros(len(ids), bool)
            for a, _, words in kernel.word_slices(batch.column(1), lower=True):
                row, bucket, count = text_buckets(words)
                own = good[a + row]
                np.add.at(raw, bucket, count)
                np.add.at(target, bucket[own], count[own])
        raw[-1], target[-1] = raw.sum(), target.sum()
        some = np.flatnonzero(raw)
        for a in range(0, len(some), 1 << 16):
            b = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(raw[b]), pa.array(target[b])], names=made.fieldNames())

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_batches, run, made)
    counts = cut(counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    whole = counts.where(F.col("bucket") == BUCKETS).first()
    out = np.zeros(BUCKETS)
    if whole is None or not 0 < whole["target"] < whole["raw"]:
        return out
    n_raw, n_target = whole["raw"], whole["target"]
    share = n_target / n_raw
    telling = counts.where(F.abs(F.col("target") - F.col("raw") * share) > z * F.sqrt(F.col("raw") * share * (1 - share))).where(F.col("bucket") < BUCKETS)
    found = telling.toPandas()  # at most BUCKETS rows
    out[found["bucket"].to_numpy()] = log_ratios(found["raw"].to_numpy(), found["target"].to_numpy(), n_raw, n_target, z)
    return out


def scored(docs: DataFrame, ratios: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``log_importance``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))  # BUCKETS numbers

    def fn(texts: pa.Array) -> list[pa.Array]:
        table, parts = shared.value, [np.zeros(0)]
        for _, _, words in kernel.word_slices(texts, lower=True):
            row, bucket, count = text_buckets(words)
            parts.append(np.bincount(row, weights=table[bucket] * count, minlength=words.rows))
        return [pa.array(np.concatenate(parts), pa.float64())]

    return with_text_columns(docs, "text", StructType([StructField("log_importance", DoubleType())]), fn, keep)


def gumbel(key: str, seed: int = SEED):
    """Gumbel noise as a function of a column: -log(-log(u)), u from 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, few: int = 4096) -> tuple[float, int]:
    """(the k-th largest value, how many are larger), exactly; 1 <= k <= rows.

    Each pass counts values in 1024 intervals and goes on with the one that
    holds the k-th, until it has a few values or cannot be divided.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / 1024
        if low == high:
            return low, above
        if width == 0 or low + width == low:  # neighbouring numbers: step through them
            rows = inside.groupBy(column).count().orderBy(F.desc(column)).collect()
        else:
            bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
            rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("count"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
            for r in rows:
                if above + r["count"] >= k:
                    break
                above += r["count"]
            low, high, n = r["low"], r["high"], r["count"]
            if n > few and low != high:
                continue
            rows = inside.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(column).count().orderBy(F.desc(column)).collect()
        for r in rows:
            if above + r["count"] >= k:
                return r[column], above
            above += r["count"]


def resample(
    docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, share: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED, targets: int = TARGETS, z: float = Z
) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id among them) with log_importance, gumbel_key and kept.

    share: of the rows that are kept; by default that of good rows among the
    labelled ones.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = F.expr("quality > 0 and toxic = 0")
    n_known, n_good = known.agg(F.count("*"), F.count(F.when(good, 1))).first()
    ids = known.where(good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).select(F.col("doc_id").cast("long")).toPandas()["doc_id"].to_numpy()
    if share is None:
        share = n_good / n_known if n_known else 1.0
    ratios = fit(docs, ids, z)
    keyed = cut(scored(docs, ratios, keep).withColumn("gumbel_key", F.col("log_importance") / temperature + gumbel("doc_id", seed)))
    rows = keyed.count()
    k = round(share * rows)
    if k >= rows or k <= 0:
        return keyed.withColumn("kept", F.lit(k > 0))
    bound, above = kth_largest(keyed, "gumbel_key", k)
    in_tie, order = F.col("gumbel_key") == bound, F.coalesce(-F.col("doc_id").cast("long"), F.lit(-(1 << 62)))  # rows without an id come last
    last, _ = kth_largest(keyed.where(in_tie).select(order.alias("id")), "id", k - above)
    return keyed.withColumn("kept", (F.col("gumbel_key") > bound) | (in_tie & (order >= last)))
