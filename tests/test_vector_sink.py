"""Appends are seen whole or not at all; a name is appended once; strays are not read."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.sources import vector_sink


def chunks(spark, ids, parts=3):
    rows = [("c", str(i), 1, None if i % 50 == 49 else f"text {i}", [float(i), 0.5]) for i in ids]
    return spark.createDataFrame(rows, "collection string, kb_document_id string, chunk_no int, content string, embedding array<float>").repartition(parts, "kb_document_id")


def numbers(spark, path):
    return sorted(int(r.kb_document_id) for r in vector_sink.restore(spark, path).collect())


def test_rows_in_batches(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_sink.append(chunks(spark, range(1000)), path)
    told = vector_sink.commits(spark, path).select(F.explode("files").alias("f")).select("f.*").collect()
    assert sum(r.rows for r in told) == 1000
    for r in told:
        file = pq.ParquetFile(f"{path}/data/{r.file}")
        sizes = [file.metadata.row_group(i).num_rows for i in range(file.metadata.num_row_groups)]
        assert len(sizes) == r.batches and sum(sizes) == r.rows and all(n == 100 for n in sizes[:-1]) and sizes[-1] <= 100
    assert numbers(spark, path) == [i for i in range(1000) if i % 50 != 49]
    assert {r.kb_document_id: r.embedding for r in vector_sink.restore(spark, path).collect()}["7"] == [7.0, 0.5]


def test_an_append_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_sink.append(chunks(spark, range(10)), path)
    before = set(os.listdir(f"{path}/data"))
    bad = chunks(spark, range(10, 600), 4).withColumn("content", F.when(F.col("kb_document_id") == "599", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        vector_sink.append(bad, path, "second")
    assert numbers(spark, path) == list(range(10)) and vector_sink.commits(spark, path).count() == 1
    # a file of a task that was lost after it wrote is not read
    stray = f"{path}/data/{next(iter(before))}"
    os.link(stray, f"{path}/data/stray.parquet")
    assert numbers(spark, path) == list(range(10))
    vector_sink.append(chunks(spark, range(10, 20)), path, "second")
    assert numbers(spark, path) == list(range(20))


def test_a_name_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "v")
    for ids in (range(5), range(100)):
        vector_sink.append(chunks(spark, ids), path, "first")
    assert numbers(spark, path) == list(range(5)) and len(os.listdir(f"{path}/data")) <= 3
    vector_sink.append(chunks(spark, range(3, 8)), path, "other")
    assert numbers(spark, path) == list(range(8))


def test_an_append_without_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_sink.append(chunks(spark, range(1)).where("false"), path, "none")
    assert [tuple(r) for r in vector_sink.commits(spark, path).collect()] == [("none", [])]
    with pytest.raises(FileNotFoundError):
        vector_sink.restore(spark, path)
