"""Exact nearest vectors (squared L2) that compares a query with few of them: cells and the triangle inequality.

Vectors are dealt to the nearest of some centres, fitted on a bounded sample; a cell
has its centre, its vectors' distances r to it, and their least and greatest.  For a query
at distance c from the centre no vector of the cell is nearer than |c - r|, so

1. each query visits the cells nearest to it that hold ``k`` vectors together; its k-th
   best distance there is its limit;
2. it visits the other cells whose least bound is within the limit, and of each cell
   compares the vectors whose own bound is: an interval, as cells are kept in order of r.

The result is that of ``dense.search``, whatever the centres are; they decide the work only.
Queries and vectors meet by an equi-join on the cell: vectors in matrices of at most
BLOCK, queries of a cell in matrices, too.  A large cell is dealt to several tasks by a
salt, and its queries are sent to each.  Queries against centres are all pairs of a
stated set with at most MOST_CELLS centres.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from docloom.functions.ship import map_batches
from docloom.functions.stored import stored
from docloom.operators.dense import DIGITS, _best

#: Centres at most, vectors of the sample for each, rounds of fitting: bounds of what the driver holds.
MOST_CELLS, SAMPLE, ROUNDS = 1024, 16, 8
BLOCK = 512
#: Vectors of a cell for one salt, about.
SALTED = 100_000
EPSILON = 1e-5

_VECTOR = [StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))]
ASSIGNED = StructType([StructField("cell", IntegerType()), StructField("r", DoubleType()), *_VECTOR])
PACKED = StructType([StructField("cell", IntegerType()), StructField("salt", IntegerType()), StructField("own", ArrayType(LongType())), StructField("r", ArrayType(DoubleType())), StructField("vectors", ArrayType(DoubleType()))])
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("distance", DoubleType()), StructField("compared", LongType())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; all must have ``width`` values."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} values expected, found one of {int(sizes[sizes != width][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _given(df: DataFrame, key: str) -> DataFrame:
    return df.where("embedding is not null").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))


def _to_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[row, centre]: distances, nearly; choices rest on them, bounds do not."""
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)


def fit(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centres from a sample of at most SAMPLE * cells vectors, the first in the order of a hash of their ids."""
    rows = _given(vectors, "vec_id")
    n = cells or min(MOST_CELLS, max(1, math.isqrt(rows.count())))
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * n).select("embedding").toArrow().column(0).combine_chunks()
    if not len(taken):
        return np.zeros((0, 0))
    sample = np.unique(_matrix(taken, len(taken[0])), axis=0)
    rng = np.random.default_rng(len(sample))
    centres = sample[rng.permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        near = _to_centres(sample, centres).argmin(axis=1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """centres; packed: vectors in matrices (see PACKED); sizes(cell, n, least, most, salts), a row for each cell that holds vectors."""

    centres: np.ndarray
    packed: DataFrame
    sizes: DataFrame


def build(vectors: DataFrame, cells: int | None = None) -> Cells:
    """The cells of ``vectors`` (vec_id, embedding); rows without a vector are left out, one of another length is an error."""
    centres = fit(vectors, cells)
    given = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS

    def assign(batches):
        own = given.value
        for batch in batches:
            rows = _matrix(batch.column(1), own.shape[1])
            near = _to_centres(rows, own).argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
            r = np.sqrt(((rows - own[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(r), *batch.columns], names=ASSIGNED.fieldNames())

    def pack(batches):
        """Rows arrive ordered by cell, salt and r; those of one (cell, salt) become matrices."""
        for batch in batches:
            cell, salt = (batch.column(i).to_numpy() for i in range(2))
            new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])])) if len(cell) else []
            for a, b in zip(new, [*new[1:], len(cell)]):
                for lo in range(a, b, BLOCK):
                    part = batch.slice(lo, min(BLOCK, b - lo))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(2), part.column(3), part.column(4).flatten())]
                    yield pa.RecordBatch.from_arrays([part.column(0)[:1], part.column(1)[:1], *lists], names=PACKED.fieldNames())

    assigned = stored(map_batches(_given(vectors, "vec_id"), assign, ASSIGNED))
    sizes = stored(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).withColumn("salts", F.ceil(F.col("n") / SALTED).cast("int")))
    salted = assigned.join(F.broadcast(sizes.select("cell", "salts")), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))  # at most MOST_CELLS rows
    dealt = salted.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "r").select("cell", "salt", "vec_id", "r", "embedding")
    return Cells(centres, stored(map_batches(dealt, pack, PACKED)), sizes)


def _visits(cells: Cells, queries: DataFrame) -> DataFrame:
    """query_id, embedding, cell, c: each query and each cell that holds vectors."""
    out = StructType([StructField("query_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("cell", IntegerType()), StructField("c", DoubleType())])
    given = queries.sparkSession.sparkContext.broadcast(cells.centres)

    def run(batches):
        own = given.value
        step = max(1, (1 << 18) // max(own.size, 1))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows = _matrix(part.column(1), own.shape[1])
                c = np.sqrt(np.stack([((own - q) ** 2).sum(axis=1) for q in rows]))
                repeat = pa.array(np.repeat(np.arange(len(rows)), len(own)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(repeat), part.column(1).take(repeat), pa.array(np.tile(np.arange(len(own), dtype=np.int32), len(rows))), pa.array(c.ravel())], names=out.fieldNames())

    return map_batches(_given(queries, "query_id"), run, out)


def _compared(cells: Cells, visits: DataFrame, k: int) -> DataFrame:
    """FOUND: for each query and matrix it visits the best k within its limit; a row without vec_id says how many were compared.

    visits: query_id, cell, c, embedding, most (the limit of the distance, not squared).
    """
    n = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("batches"))
    dealt = visits.join(F.broadcast(n), "cell").join(F.broadcast(cells.sizes.select("cell", "salts")), "cell")  # both at most MOST_CELLS rows
    asked = dealt.groupBy("cell", "salts", F.pmod(F.xxhash64("query_id"), F.col("batches")).alias("batch")).agg(F.collect_list(F.struct("query_id", "c", "most", "embedding")).alias("q"))  # about BLOCK each
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = cells.packed.join(asked, ["cell", "salt"]).select("own", "r", "vectors", F.col("q.query_id").alias("ids"), F.col("q.c").alias("c"), F.col("q.most").alias("most"), F.flatten("q.embedding").alias("rows"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, r, vectors, ids, c, most, rows = (batch.column(j)[i].values.to_numpy() for j in range(7))
                vectors, rows = vectors.reshape(len(own), -1), rows.reshape(len(ids), -1)
                lo, hi = np.searchsorted(r, c - most - EPSILON), np.searchsorted(r, c + most + EPSILON, side="right")
                query, vec, distance = [], [], []
                for q in np.flatnonzero(hi > lo):
                    d = np.round(((vectors[lo[q] : hi[q]] - rows[q]) ** 2).sum(axis=1), DIGITS)
                    best = _best(d[None], own[lo[q] : hi[q]], k)[0]
                    query.append(np.full(len(best), ids[q]))
                    vec.append(own[lo[q] : hi[q]][best])
                    distance.append(d[best])
                none = pa.nulls(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids), none.cast(pa.int64()), none.cast(pa.float64()), pa.array((hi - lo).astype(np.int64))], names=FOUND.fieldNames())
                if query:
                    found = [np.concatenate(x) for x in (query, vec, distance)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.nulls(len(found[0])).cast(pa.int64())], names=FOUND.fieldNames())

    return map_batches(met, run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def find(cells: Cells, queries: DataFrame, k: int = 10) -> DataFrame:
    """FOUND rows of both rounds, stored: all that ``top`` and ``work`` need.  queries: query_id (once each), embedding."""
    if not len(cells.centres):
        return queries.sparkSession.createDataFrame([], FOUND)
    bound = F.greatest(F.lit(0.0), F.col("c") - F.col("most"), F.col("least") - F.col("c"))
    sized = cells.sizes.select("cell", "n", "least", "most")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("c", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = _visits(cells, queries).join(F.broadcast(sized), "cell").withColumn("bound", bound).drop("least", "most").withColumn("before", before)
    visits = stored(visits.withColumn("near", F.col("before") < k).select("query_id", "cell", "c", "bound", "near", "embedding"))
    one = stored(_compared(cells, visits.where("near").withColumn("most", F.lit(float("inf"))), k))
    limit = _first(one, k).where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("most"))
    rest = visits.where("not near").join(limit, "query_id").where(F.col("bound") <= F.col("most") + EPSILON)
    # where the near cells hold fewer than k, they are all there are
    return one.unionByName(stored(_compared(cells, rest, k)))


def top(found: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance, like ``dense.search``."""
    return _first(found, k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")


def work(found: DataFrame) -> DataFrame:
    """query_id, compared: with how many vectors the query was compared."""
    return found.groupBy("query_id").agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
