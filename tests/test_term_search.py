"""Search over texts in the tasks that have all postings of their documents."""

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import term_search
from docloom.functions import text as T
from docloom.operators import bm25, dense
from tests.test_segments import rows_of, sent_records

ODD = ["Ab a_b_ x 12 é éé ÉÀ", None, "", "x", "日本 語 ΣΑΣ İstanbul", "𝔘𝔘 𝔘 áb ²³ ½½ ٠١", "😀word😀😀", "a\x00bc\ndef", "the of", "_ __ ___", "ªº ʰʱ ⅷⅸ 〇〇", "é"]


def test_words_are_those_of_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(term_search, "SLICE_BYTES", 16)
    given = spark.createDataFrame(list(enumerate(ODD * 3)), "id long, text string").orderBy("id")
    rows = given.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), T.words(F.col("text")).alias("words")).collect()
    got = [[] for _ in rows]
    for a, _, row, words in term_search.words_of(pa.array([r.text for r in rows]), term_search.word_points(spark)):
        for i, w in zip(row.tolist(), words.to_pylist()):
            got[a + i].append(w)
    assert got == [r.words for r in rows]


def test_pairs_of_queries_and_documents_are_not_exchanged(spark):
    """60 questions with words of all 1,500 documents: 90,000 pairs have a score, 4,500 postings are sent."""
    docs = spark.createDataFrame([(i, f"w1 w2 w3 {'w2 ' * (i % 7)} x{i}") for i in range(1500)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w1 w2 w3 x{i}") for i in range(60)], "query_id long, text string")
    assert sent_records(spark, lambda: bm25.search(docs, queries, 3).collect()) < 30_000


def test_rows_of_one_id_and_of_none(spark, monkeypatch):
    rows = [(1, "apple pear"), (1, "apple apple"), (None, "pear fig"), (None, "fig"), (4, None), (5, "apple"), (6, "pear apple fig")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "apple"), (2, "pear fig fig"), (3, None)], "query_id long, text string")
    got = rows_of(bm25.search(docs.where("doc_id is not null"), queries, 3)), bm25.search(docs, queries, 3).count()
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)  # by shuffled joins
    assert got == (rows_of(bm25.search(docs.where("doc_id is not null"), queries, 3)), bm25.search(docs, queries, 3).count())



def test_one_block_of_queries_is_not_paired_with_packed_vectors(spark, monkeypatch):
    """Vectors pass one Python function, as rows; with more queries than a block the result is the same."""
    vectors = spark.createDataFrame([(i, [float((i * j) % 11) for j in range(1, 9)]) for i in range(200)] + [(500, None)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = dense.search(vectors, queries, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(dense, "BLOCK", 4)
    assert sorted(map(tuple, dense.search(vectors, queries, 5).collect())) == rows and len(rows) == 50
