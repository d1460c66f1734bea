"""The question flow, the external search source, traces."""

import json

from pyspark.sql import functions as F

from docloom.operators import chat_flow, guardrail, judge
from docloom.sources import search_api, tables


def frames(spark):
    docs = spark.createDataFrame([(0, "cheque bounce notice period thirty days", "a"), (1, "rent agreement for a house", "b"), (2, "cheque bounce notice period thirty days", "b")], "doc_id long, text string, source string")
    questions = spark.createDataFrame([(0, "cheque bounce notice"), (1, "best pizza recipes"), (2, "zebra quantum"), (3, "rent house zebra")], "query_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    return docs, questions, vectors, vectors.withColumnRenamed("vec_id", "query_id")


def test_answer(spark):
    docs, questions, vectors, asked = frames(spark)
    for owned in (None, F.col("source") == "b"):
        got = {r.query_id: r for r in chat_flow.answer(questions, docs, vectors, asked, owned).collect()}
        assert (got[0].decision, got[0].chunk_ids) == ("PASS", ["0"]) and "thirty days" in got[0].prompt and '<chunk id="1">' in got[0].prompt
        assert (got[1].gate, got[1].decision, got[1].prompt) == ("fail", None, chat_flow.REFUSAL)
        assert (got[2].decision, got[2].prompt) == ("FALLBACK", judge.FALLBACK_MESSAGE)
        assert (got[3].decision, got[3].needs_retry, got[3].chunk_ids) == ("RETRY", True, ["1"])


def test_injected_models(spark):
    docs, questions, vectors, asked = frames(spark)
    models = chat_flow.Models(gate=lambda q: F.lit(None).cast("string"), rerank=lambda q, t: F.lit(1.0))
    assert {r.decision for r in chat_flow.answer(questions, docs, vectors, asked, models=models).collect()} == {"PASS"}
    assert spark.range(1).select(guardrail.blocks(F.lit(None).cast("string"))).first()[0] is False


def test_external_search(spark, tmp_path):
    (tmp_path / "3.json").write_text(json.dumps([{"tid": 7, "fragment": True, "docsource": "c"}, {"tid": 8, "fragment": "yes"}]))
    name = search_api.register(spark)
    rows = spark.read.format(name).option("path", str(tmp_path)).option("queries", "[3, 4]").load().orderBy("position").collect()
    assert [(r.query_id, r.position, r.tid, r.fragment) for r in rows] == [(4, None, None, False), (3, 0, 7, True), (3, 1, 8, False)]
    assert rows[0].error.startswith("FileNotFoundError") and rows[1].error is None


def test_trace(spark):
    df, seen = tables.traced(spark.range(5), "ids")
    df.collect()
    assert seen.get == {"rows": 5}
