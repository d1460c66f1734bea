"""Exact dense search: nearest vectors by squared L2 distance or cosine.

Up to BLOCK queries go to the tasks that read the vectors.  More meet all vectors in
blocks: vectors and queries are packed into matrices of BLOCK rows where they are
read, each pair of matrices is one row of work.  What is shuffled is the best k for
each query and matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from docloom.functions.ship import map_batches

BLOCK = 4096
DIGITS = 6


def distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """[query, row]: smaller is nearer."""
    if metric == "cosine":
        norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return 1 - norm(queries) @ norm(rows).T
    return np.stack([((rows - q) ** 2).sum(axis=1) for q in queries])


def _best(d: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """[query, place]: the k smallest of each row of d, equal ones by the smallest id."""
    n = d.shape[1]
    if n <= k:
        return np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)
    bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d), k), np.int64)
    for q, (row, most) in enumerate(zip(d, bound)):
        near = np.flatnonzero(row <= most)
        out[q] = near[np.lexsort((own[near], row[near]))][:k]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """query_id, rank, vec_id, distance for ``queries`` (query_id, embedding) over ``vectors`` (vec_id, embedding).

    Filter ``vectors`` before the call: the condition then reaches the scan.
    Rows without a vector are no neighbours; vectors of different lengths are an
    error.  More than BLOCK queries are packed into blocks by the executors, and
    each meets each slice of vectors; ``cells`` gives the same result with fewer
    comparisons.
    """
    out = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("distance", DoubleType())])
    given = lambda df, key: df.where("embedding is not null").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = given(queries, "query_id")
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank long, vec_id long, distance double")
    best_of = _meets(out, metric, k)
    if n <= BLOCK:  # one block of queries goes to all tasks, and vectors are met where they are read
        rows = asked.toArrow()
        ids, wanted = rows["query_id"].to_numpy(), pc.list_flatten(rows["embedding"]).to_numpy()

        def here(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    own, lists = (batch.column(c).slice(a, BLOCK) for c in (0, 1))
                    if len(np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))) > 1:
                        raise ValueError("vectors of different lengths can't be compared")
                    yield best_of(own.to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), ids, wanted)

        return _ranked(map_batches(given(vectors, "vec_id"), here, out), k)
    of = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))).cast("int")
    blocks = asked.groupBy(of.alias("block")).agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("rows"))  # about BLOCK queries each
    parts = _packed(given(vectors, "vec_id"))
    met = parts.crossJoin(blocks)  # a stated set of queries against all vectors, block by block

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, rows, ids, wanted = (batch.column(c)[i].values.to_numpy() for c in range(4))
                yield best_of(own, rows, ids, wanted)

    return _ranked(map_batches(met.select("own", "vectors", "ids", "rows"), run, out), k)


def _meets(out: StructType, metric: str, k: int):
    """(ids and values of vectors, ids and values of queries) to rows of the k best of each query."""

    def run(own, rows, ids, wanted):
        if len(rows) * len(ids) != len(wanted) * len(own):
            raise ValueError("vectors of different lengths can't be compared")
        d = np.round(distances(rows.reshape(len(own), -1), wanted.reshape(len(ids), -1), metric), DIGITS)
        best = _best(d, own, k)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(own[best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())], names=out.fieldNames())

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")


def _packed(vectors: DataFrame) -> DataFrame:
    """own, vectors: ids and values of the vectors of each Arrow batch in one row."""
    made = StructType([StructField("own", ArrayType(LongType())), StructField("vectors", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                if len(np.unique(part.column(1).value_lengths().to_numpy(zero_copy_only=False))) > 1:
                    raise ValueError("vectors of different lengths can't be compared")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(0), part.column(1).flatten())]
                yield pa.RecordBatch.from_arrays(lists, names=made.fieldNames())

    return map_batches(vectors, run, made)


def route(utterances: DataFrame, queries: DataFrame, top: int = 5, threshold: float = 0.5) -> DataFrame:
    """query_id, route, score: the route with the best mean cosine among a query's ``top`` nearest utterances, null below the threshold.

    utterances: vec_id, route, embedding.
    """
    near = search(utterances, queries, top, "cosine").join(utterances.select("vec_id", "route"), "vec_id")
    means = near.groupBy("query_id", "route").agg(F.round(F.avg(1 - F.col("distance")), 5).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "route")
    best = means.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.select("query_id", F.when(F.col("score") >= threshold, F.col("route")).alias("route"), "score")
