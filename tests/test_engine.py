"""Judge, guardrail, privacy, quota, retrieval and application operators."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import app, bm25, dense, guardrail, judge, privacy, quota, retrieval
from docloom.sources import tables
from docloom.streaming import pipelines


def test_decide(spark):
    cases = [
        (True, True, True, 0.78, 0.78, "PASS"), (True, True, False, 0.90, 0.90, "RETRY"), (True, False, True, 0.95, 0.90, "RETRY"), (True, False, True, 0.95, 0.49, "FALLBACK"),
        (True, True, True, 0.50, 0.10, "RETRY"), (True, True, True, 0.7799, 0.99, "RETRY"), (False, True, True, 0.99, 0.4999, "FALLBACK"),
    ]
    for relevant, typed, supports, score, confidence, expected in cases:
        raw = f'{{"query": "q", "confidence": {confidence}, "overall_decision": "PASS", "chunk_results": [{{"chunk_id": "c", "relevant": {str(relevant).lower()}, "chunk_type_match": {str(typed).lower()}, "supports_answer": {str(supports).lower()}, "score": {score}, "reason": "r"}}]}}'
        v = spark.createDataFrame([(raw,)], "raw string").select(judge.parse(F.col("raw")).alias("v"))
        row = judge.evaluate(v.select("v.confidence", "v.chunk_results")).first()
        assert row.decision == expected and (row.fallback_message is not None) == (expected == "FALLBACK")
        assert v.select(judge.violations(F.col("v"))).first()[0] == []
    empty = spark.createDataFrame([(0.9, [])], f"confidence double, chunk_results array<{judge.CHUNK}>")
    assert judge.evaluate(empty).first().decision == "FALLBACK"


def test_scores_are_rounded_as_doubles(spark):
    r = random.Random(6)
    values = [(2 * n + 1) / 20000 for n in range(10_000)] + [r.random() for _ in range(5000)] + [r.uniform(-3, 3) for _ in range(2000)] + [0.0, 1.0, 0.03125, 0.09375, 1 / 3, 1e-9, 12345.67895, -0.00015]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", judge.rounded(F.col("x")).alias("y")).collect()
    assert all(row.y == round(row.x, 4) for row in rows) and len(rows) == len(values)
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(judge.rounded(F.col("x")).alias("y")).where("y is null or isnan(y)").count() == 2


def test_violations(spark):
    raw = '{"query": " ", "confidence": 1.5, "overall_decision": "RETRY", "chunk_results": [{"chunk_id": "", "score": 2, "reason": " "}]}'
    found = spark.createDataFrame([(raw,)], "raw string").select(judge.violations(judge.parse(F.col("raw")))).first()[0]
    assert len(found) == 6


def test_guardrail(spark):
    df = spark.createDataFrame([("<GATE> Pass </GATE><response> a </response>",), ("<Response>a</Response>",), ("<response></response>",)], "raw string")
    got = [tuple(r[0]) for r in df.select(guardrail.parse(F.col("raw"))).collect()]
    assert got == [("pass", "a", None), (None, None, None), (None, "", None)]
    queries = {"best pizza recipes": "fail", "cheque bounce joke": "pass", "how do I get bail?": "pass", "who are you": "pass"}
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select("q", guardrail.keyword_gate(F.col("q")).alias("g")).collect()
    assert {r.q: r.g for r in rows} == queries


def test_mask_and_restore(spark):
    text = "Rohan Sen of Acme Ltd. Rohan Sen signed. Acme."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = privacy.mask_documents(df, {"PERSON": ["Rohan Sen"], "COMPANY": ["Acme Ltd", "Acme"]}).first()
    assert row.restored == text
    entities = F.from_json(F.lit('[{"pos":1,"label":"PERSON","value":"Rohan Sen"},{"pos":14,"label":"COMPANY","value":"Acme Ltd"},{"pos":24,"label":"PERSON","value":"Rohan Sen"},{"pos":42,"label":"COMPANY","value":"Acme"}]'), f"array<{privacy.ENTITY}>")
    pairs = privacy.mapping(entities)
    got = df.select(privacy.mask(F.col("text"), pairs).alias("m"), privacy.restore(privacy.mask(F.col("text"), pairs), pairs).alias("r")).first()
    assert got.m == "[PERSON_1] of [COMPANY_1]. [PERSON_1] signed. [COMPANY_2]." and got.r == text
    rows = spark.createDataFrame([(1, 1, "person", "Rohan Sen"), (1, 14, "company", "Acme Ltd"), (1, 24, "person", "Rohan Sen"), (1, 42, "company", "Acme")], "doc_id long, pos int, label string, value string")
    assert {r.value: r.placeholder for r in privacy.number_entities(rows).collect()} == {"Rohan Sen": "[PERSON_1]", "Acme Ltd": "[COMPANY_1]", "Acme": "[COMPANY_2]"}


def random_events(n=300):
    r = random.Random(9)
    return [(i, r.randrange(3), dt.datetime(2024, 1, 30) + dt.timedelta(minutes=r.randrange(6000)), r.choice(["reserve", "reserve", "adjust"]), r.choice([600, 600, 150, -200])) for i in range(n)]


SCHEMA = "event_id long, user_id long, ts timestamp, kind string, amount long"


def replay(events, limits):
    used, out = Counter(), {}
    for i, u, ts, kind, amount in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        d, m = (u, ts.strftime("%Y-%m-%d")), (u, ts.strftime("%Y-%m"))
        ok = kind == "adjust" or (used[d] + amount <= limits.daily and used[m] + amount <= limits.monthly)
        if ok:
            used[d] += amount
            used[m] += amount
        out[i] = (ok, used[d], used[m])
    return out


def test_quota_fold_and_closed_form(spark):
    day = dt.datetime(2024, 1, 1)
    events = [(1, 1, day, "reserve", 600), (2, 1, day + dt.timedelta(minutes=1), "adjust", -200), (3, 1, day + dt.timedelta(minutes=2), "reserve", 600), (4, 1, day + dt.timedelta(minutes=3), "adjust", 150), (5, 1, day + dt.timedelta(minutes=4), "reserve", 600)]
    got = quota.fold(spark.createDataFrame(events, SCHEMA)).orderBy("event_id").collect()
    assert [(r.admitted, r.day_used) for r in got] == [(True, 600), (True, 400), (True, 1000), (True, 1150), (False, 1150)]
    events = random_events()
    assert {r.event_id: (r.admitted, r.day_used, r.month_used) for r in quota.fold(spark.createDataFrame(events, SCHEMA)).collect()} == replay(events, quota.CHAT_TOKENS)
    units = [(i, u, ts, "reserve", 1) for i, u, ts, _, _ in events]
    limits = quota.Limits(2, 5)
    closed = quota.admit_units(spark.createDataFrame(units, SCHEMA), limits).collect()
    assert {r.event_id: r.admitted for r in closed} == {k: v[0] for k, v in replay(units, limits).items()}


def test_quota_stream_is_the_fold(spark, tmp_path):
    events = sorted(random_events(120), key=lambda e: (e[2], e[0]))
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = pipelines.quota_stream(stream).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.event_id: (r.admitted, r.day_used, r.month_used) for r in spark.table("decisions").collect()} == replay(events, quota.CHAT_TOKENS)


def test_a_late_event_counts_in_its_own_day(spark, tmp_path):
    day = dt.datetime(2024, 1, 10, 12)
    waves = [[(1, 1, day, "reserve", 600)], [(2, 1, day - dt.timedelta(days=1), "reserve", 600)], [(3, 1, day + dt.timedelta(minutes=1), "reserve", 600), (4, 1, day - dt.timedelta(days=1), "reserve", 400)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for wave in waves:
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = pipelines.quota_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
    got = {r.event_id: (r.admitted, r.day_used, r.month_used) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, 600, 600), 2: (True, 600, 1200), 4: (True, 1000, 1600), 3: (False, 600, 1600)}


def test_keys_are_utc(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 3, 31, 23, 30, tzinfo=dt.timezone.utc),)], "ts timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("Asia/Kolkata", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = rows.select(T.day_key(F.col("ts")), T.month_key(F.col("ts")), T.day_key(F.lit("2024-03-31 23:30:00").cast("timestamp_ntz"))).first()
            assert tuple(got) == ("2024-03-31", "2024-03", "2024-03-31"), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ingest_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([(1, "# A\none two"), (2, "three")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = pipelines.ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "chunks"), str(tmp_path / "status"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.doc_id, r.structural_path, r.content) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()) == [(1, "A", "one two"), (2, "Root", "three")]
    assert {r.status for r in spark.read.parquet(str(tmp_path / "status")).collect()} == {"completed"}


def test_bm25_against_the_formula(spark):
    texts = ["apple banana apple", "banana cherry", "the of", "", None, "apple"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bm25.search(docs, spark.createDataFrame([(7, "Apple apple zzz"), (8, None)], "query_id long, text string"), 4).orderBy("query_id", "rank").collect()
    n, avg, df = 6, (3 + 2 + 1) / 6, 2
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    score = lambda tf, dl: round(2 * idf * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg)), 6)
    assert [(r.doc_id, r.score) for r in got if r.query_id == 7] == [(5, score(1, 1)), (0, score(2, 3)), (1, 0.0), (2, 0.0)]
    assert [r.doc_id for r in got if r.query_id == 8] == [0, 1, 2, 3]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "apple banana"), (1, "apple")], "doc_id long, text string")
    bm25.build(docs).write(str(tmp_path / "index"))
    assert {r.term: r.df for r in bm25.Index.read(spark, str(tmp_path / "index")).terms.collect()} == {"apple": 2, "banana": 1}
    assert bm25.merged(docs, docs).count() == 4


def test_dense_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (50, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    queries = rows.where("vec_id < 8").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank): r.vec_id for r in dense.search(rows, queries, 4).collect()}
    for q in range(8):
        order = sorted(range(50), key=lambda i: (((v[i] - v[q]) ** 2).sum(), i))
        assert [got[q, k + 1] for k in range(4)] == order[:4]


def test_first_wins_and_rerank(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue fox"), (4, "x")], "doc_id long, text string")
    lists = {"dense_internal": spark.createDataFrame([(0, 1, 2)], "query_id long, rank long, doc_id long"), "bm25_internal": spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 4)], "query_id long, rank long, doc_id long")}
    fused = retrieval.first_wins(retrieval.union_lists(lists), docs)
    assert {r.doc_id for r in fused.collect()} == {2, 3, 4}
    top = retrieval.rerank(fused, spark.createDataFrame([(0, "blue fox")], "query_id long, text string"), 2).orderBy("final_rank").collect()
    assert [(r.doc_id, r.rerank_score) for r in top] == [(3, 1.0), (2, 0.5)]


def test_uploads_and_files(spark, tmp_path):
    cases = [("a.pdf", 2 * 1024 * 1024 + 1, "%PDF-", 413), ("a.tar.pdf", 9, "%PDF-", 400), ("a.txt", 9, "%PDF-", 400), ("A.PDF", 9, "%PDF-1", 0), (".pdf", 9, "%PDF-", 400), ("a.pdf", 9, "<html", 400), ("a.pdf", 9, None, 400)]
    df = spark.createDataFrame(cases, "name string, size long, head string, code int")
    assert all(r.got == r.code for r in df.select("code", app.upload_verdict(F.col("name"), F.col("size"), F.col("head"))["code"].alias("got")).collect())
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 body")
    (tmp_path / "y.txt").write_text("no")
    files = tables.pdf_files(spark, str(tmp_path)).collect()
    assert [(f.name, f.stem, f.head[:5]) for f in files] == [("x.pdf", "x", "%PDF-")]


def test_application_tables(spark):
    users = spark.createDataFrame([("a@b.cd",)], "email string")
    rows = app.rejected_signups(spark.createDataFrame([("Al", "a@b.cd", "12345"), ("Alice", "new@b.cd", "123456")], "name string, email string, password string"), users).orderBy("name").collect()
    assert [len(r.reasons) for r in rows] == [3, 0]
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)], "conv_id long, turn long, role string, text string")
    assert app.history(m).first().history.split("\n\n") == ["User: t2", "Assistant: t3", "User: t4", "Assistant: t5", "User: t6"]
    assert app.audit(m).count() == 3
    t = spark.createDataFrame([([["a", None], ["x\ny", "z"]],)], "t array<array<string>>").select(app.table_markdown(F.col("t"))).first()[0]
    assert t == "| a |  |\n| --- | --- |\n| x y | z |"


def test_vector_table_and_external_hits(spark, tmp_path):
    chunks = spark.createDataFrame([("kb", "d", 1, "text"), ("kb", "d", 2, "")], "collection string, kb_document_id string, chunk_no int, content string")
    for _ in range(2):
        tables.append_vectors(chunks, str(tmp_path / "v"))
    assert tables.restore_vectors(spark, str(tmp_path / "v")).count() == 1
    hits = spark.createDataFrame([(0, i, 10 + i, i != 1, "court", "2020") for i in range(5)], "query_id long, position int, tid int, fragment boolean, docsource string, publishdate string")
    fragments = spark.createDataFrame([(10 + i, ["<b>a</b>", "&amp; b"], "T") for i in range(5)], "tid int, headline array<string>, title string")
    got = tables.external_chunks(hits, fragments).orderBy("position").collect()
    assert [(r.doc_id, r.content) for r in got] == [(10, "a & b"), (12, "a & b")]
