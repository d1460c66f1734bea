"""Search by cells against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import cells, dense

SCHEMA = "vec_id long, embedding array<float>"


def plain(v, ids, queries, k):
    out = {}
    for q, x in queries.items():
        d = np.round(((v - x) ** 2).sum(axis=1), 6)
        out |= {(q, i + 1): ids[j] for i, j in enumerate(np.lexsort((ids, d))[:k])}
    return out


def ranks(df):
    return {(r.query_id, r.rank): r.vec_id for r in df.collect()}


def test_ties_copies_and_salts(spark, monkeypatch):
    """Small whole numbers: many equal distances; half of the vectors are copies of one, so its cell is dealt by salts."""
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(cells, "SALTED", 40)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 4, (200, 5)), np.tile([1, 2, 3, 0, 1], (200, 1))]).astype(float)
    ids = np.arange(400)
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)] + [(1000, None)], SCHEMA).repartition(5)
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    made = cells.build(rows, 12)
    assert made.sizes.agg(F.max("salts")).first()[0] > 1
    expected = plain(v, ids, {i: v[i] for i in range(0, 400, 20)}, 7)
    assert ranks(cells.top(cells.find(made, queries, 7), 7)) == expected
    assert ranks(dense.search(rows, queries, 7)) == expected


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 20
    v = np.float32(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(4)
    queries = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = cells.find(cells.build(rows), queries, 10)
    assert ranks(cells.top(found, 10)) == plain(v, np.arange(3000), {i: v[i] for i in range(0, 3000, 100)}, 10)
    assert cells.work(found).agg(F.sum("compared")).first()[0] < 30 * 3000 / 5


def test_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0])], SCHEMA)
    queries = spark.createDataFrame([(9, [0.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert ranks(cells.top(cells.find(cells.build(rows), queries, 10), 10)) == {(9, 1): 1, (9, 2): 2}
    assert ranks(cells.top(cells.find(cells.build(rows.where("vec_id > 9")), queries, 10), 10)) == {}


def test_other_lengths_are_errors(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0])], SCHEMA)
    queries = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="vectors of"):
        cells.build(rows)
    with pytest.raises(Exception, match="different lengths"):
        dense.search(rows, queries).collect()
    with pytest.raises(Exception, match="vectors of"):
        cells.find(cells.build(rows.where("vec_id = 1")), queries.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))).collect()
