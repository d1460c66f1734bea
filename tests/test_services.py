"""Sources, hooks and chains that registered queries reach only in part."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import app, bm25, chat_flow, privacy, structure
from docloom.sources import tables


def test_a_database_table_in_ranges(spark):
    url, driver = "jdbc:derby:memory:docloom;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"))
    try:
        tables.append_jdbc(rows, url, "T", driver=driver)
    except Exception as e:
        pytest.skip(f"no embedded database: {type(e).__name__}")
    got = tables.jdbc_table(spark, url, "T", "K", 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and {tuple(r) for r in got.collect()} == {(i, 2 * i) for i in range(100)}


def test_rows_in_memory(spark):
    got = tables.json_rows(spark, [{"a": 1, "b": "x"}, {"b": "y", "c": 3}], "a bigint, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (None, "y")]


def test_index_exists_only_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not bm25.index_exists(spark, path)
    index = bm25.build(spark.createDataFrame([(0, "apple")], "doc_id long, text string"))
    index.postings.write.parquet(f"{path}/postings")
    assert not bm25.index_exists(spark, path)
    index.write(path)
    assert bm25.index_exists(spark, path)


def test_index_search_is_the_search(spark):
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["apple banana apple", "banana cherry", "the of", "", None, "apple"])], "doc_id long, text string, half int")
    queries = spark.createDataFrame([(7, "Apple apple zzz"), (8, None)], "query_id long, text string")
    for condition in (None, F.col("half") == 1):
        allowed = None if condition is None else docs.where(condition).select("doc_id")
        a, b = bm25.search(docs, queries, 4, condition), bm25.search_index(bm25.build(docs), queries, 4, allowed)
        assert sorted(a.collect()) == sorted(b.collect())


def test_any_keys(spark):
    docs = spark.createDataFrame([(1, "u", "k"), (2, "u", None), (3, None, "k")], "doc_id long, user string, kb string")
    ids = lambda **wanted: [r.doc_id for r in docs.where(bm25.keys_filter(wanted)).orderBy("doc_id").collect()]
    assert ids() == ids(user=None, kb="") == [1, 2, 3] and ids(user="u") == [1, 2] and ids(user="u", kb="k") == [1] and ids(kb="none") == []
    assert bm25.all_given({"a": "x", "b": "y"}) and not bm25.all_given({"a": "x", "b": ""})


def test_a_recogniser_is_a_function(spark):
    df = spark.createDataFrame([("Ann met Bo at 12 Long Hill Road",)], "text string")
    ask = lambda text: F.from_json(F.lit('[{"label": "PERSON", "value": "Bo"}]'), "array<struct<label:string,value:string>>")
    got = df.select(privacy.detect(F.col("text"), {"PERSON": ["Ann"]}, ask)).first()[0]
    assert [(e.pos, e.label, e.value) for e in got] == [(1, "PERSON", "Ann"), (9, "PERSON", "Bo"), (15, "STREET ADDRESS", "12 Long Hill Road")]


def test_extraction_from_items_to_payload(spark):
    lines = ["Synopsis", "| 1 | Offer here |", "1 Offer here", "CHAPTER I", "An offer binds whoever makes it", "9 A v B, AIR 1950", "Acceptance ends the offer for good"]
    items = [(1, i, "footnote" if i == 5 else "text", t, 1 + i // 4) for i, t in enumerate(lines)]
    df = spark.createDataFrame(items[::-1], "doc_id long, ord int, label string, text string, page int")
    rows = structure.payload(structure.extracted(df, [{"CHAPTER I": {}}]), F.lit(5), F.lit(6)).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.structural_path, r.page_number, r.content) for r in rows] == [
        ("1_1", "Root", None, "1 Offer here"),
        ("1_2", "CHAPTER I", 2, "An offer binds whoever makes it \nAcceptance ends the offer for good".replace(" \n", " ")),
    ]
    assert (rows[0].user_id, rows[0].kb_id, rows[0].kb_document_id) == ("5", "6", "1")


def test_converse_by_route(spark):
    docs = spark.createDataFrame([(0, "lease notice period thirty days"), (1, "template of a lease"), (2, "other words")], "doc_id long, text string")
    questions = spark.createDataFrame([(0, "lease notice period"), (1, "draft it"), (2, "zebra quantum"), (3, "zebra yak"), (4, "a joke"), (5, "nowhere")], "query_id long, text string")
    routes = spark.createDataFrame([(0, "knowledge_base"), (1, "template_doc"), (2, "knowledge_base"), (3, "knowledge_base"), (4, "knowledge_base"), (5, None)], "query_id long, route string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "query_id long, embedding array<float>")
    external = spark.createDataFrame([(2, 1, 71, "second"), (2, 0, 70, "first"), (0, 0, 72, "unused")], "query_id long, position int, doc_id long, content string")
    histories = spark.createDataFrame([(0, "User: hello")], "query_id long, history string")
    got = {r.query_id: r for r in chat_flow.converse(questions, routes, docs, vectors, asked, vectors.where("vec_id = 1"), external, histories).collect()}
    assert [(got[i].origin, got[i].decision, got[i].chunk_ids) for i in range(6)] == [
        ("knowledge_base", "PASS", ["0"]), ("template_doc", None, ["1"]), ("external", "FALLBACK", ["70", "71"]), ("none", "FALLBACK", []), ("none", None, []), ("none", None, []),
    ]
    assert got[0].prompt.startswith("User: hello\n\n<chunk") and got[0].prompt.endswith("Question: lease notice period")
    assert got[4].prompt == chat_flow.REFUSAL and app.NO_HISTORY in got[5].prompt
