"""The index of segments and search by score bounds, against the plain search over the documents that are live."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from docloom.operators import block_max, bm25, segments
from docloom.operators.segments import Segments

SF = "/root/testdata/sf0.01"


def made(n, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    return [(i, " ".join(r.choices(words, k=int(r.paretovariate(0.8)) % 400)) or None) for i in range(n)]


def asked(spark, rows, n=25, size=4, seed=2):
    r = random.Random(seed)
    texts = [t for _, t in rows if t and len(t.split()) > size]
    return spark.createDataFrame([(i, " ".join(r.sample(r.choice(texts).split(), size))) for i in range(n)] + [(90, None), (91, "unknownword"), (92, "w1 w1 w2")], "query_id long, text string")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bounds_give_the_plain_result(spark, tmp_path, monkeypatch):
    rows = made(400)
    index, docs, queries = Segments(spark, str(tmp_path / "i")), frame(spark, rows), asked(spark, rows)
    index.add(docs)
    expected = rows_of(bm25.search(docs, queries, 5))
    assert rows_of(block_max.search(index, queries, 5)) == expected
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)  # all by shuffled joins
    assert rows_of(block_max.search(index, queries, 5)) == expected
    assert rows_of(bm25.search(docs, queries, 5)) == expected


def test_postings_that_are_not_scored(spark, tmp_path):
    """Two rare words and two frequent ones, as a user asks: most postings are those of the frequent ones, and few are scored."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = Segments(spark, str(tmp_path / "i"))
    index.add(docs)
    of = {r.term: r.df for r in index.terms().collect()}
    r = random.Random(3)
    frequent = sorted(of, key=lambda t: (-of[t], t))[:40]
    rare = sorted(t for t, n in of.items() if 5 <= n <= 12)
    queries = spark.createDataFrame([(i, " ".join(r.sample(rare, 2) + r.sample(frequent, 2))) for i in range(30)], "query_id long, text string")
    found = block_max.find(index, queries, 3)
    postings, scored = found.work.agg(F.sum("postings"), F.sum("scored")).first()
    assert 0 < scored < postings / 3


@pytest.mark.parametrize("steps", ["A d B D", "A d B A2 c D"])
def test_changes_equal_a_rebuild(spark, tmp_path, steps):
    rows = made(300)
    parts = {"A": rows[:150], "B": rows[150:], "A2": made(300, 5)[:60]}
    gone = {"d": range(0, 60), "D": range(100, 260, 3)}
    index, live = Segments(spark, str(tmp_path / "i")), {}
    for step in steps.split():
        if step == "c":
            index.compact()
        elif step in parts:
            index.add(frame(spark, parts[step]))
            live |= dict(parts[step])
        else:
            index.delete(spark.createDataFrame([(i,) for i in [*gone[step], 10_000]], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in gone[step]}
    docs, queries = frame(spark, sorted(live.items())), asked(spark, rows)
    plain = bm25.build(docs)
    assert index.totals()[0] == len(live) and index.totals()[1] == pytest.approx(plain.totals.first().avgdl)
    assert sorted(map(tuple, index.terms().select("term", "df").collect())) == sorted((r.term, r.df) for r in plain.terms.collect())
    expected = rows_of(bm25.search(docs, queries, 5))
    assert rows_of(block_max.search(index, queries, 5)) == expected
    assert rows_of(bm25.search_index(index.index(), queries, 5)) == expected


def test_adding_reads_no_old_text(spark, tmp_path):
    rows = made(60)
    frame(spark, rows[:30]).write.parquet(str(tmp_path / "old"))
    index = Segments(spark, str(tmp_path / "i"))
    index.add(spark.read.parquet(str(tmp_path / "old")))
    shutil.rmtree(tmp_path / "old")
    index.add(frame(spark, rows[30:]))
    index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    index.compact()
    assert index.totals()[0] == 59


def test_a_failed_write_is_not_visible(spark, tmp_path, monkeypatch):
    rows = made(40)
    index = Segments(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.blocks()
    index.add(frame(spark, rows[:20]))
    before = sorted(map(tuple, index.terms().collect()))

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(Segments, "_finish", lost)
        for change in (lambda: index.add(frame(spark, rows[20:])), lambda: index.delete(spark.createDataFrame([(1,)], "doc_id long")), index.compact):
            with pytest.raises(RuntimeError):
                change()
    assert sorted(map(tuple, index.terms().collect())) == before and index.totals()[0] == 20
    assert index.add(frame(spark, rows[20:])) == 2 and index.totals()[0] == 40


def test_empty_segments_and_texts(spark, tmp_path):
    index = Segments(spark, str(tmp_path / "i"))
    index.add(frame(spark, []))
    index.add(frame(spark, [(1, None), (2, ""), (3, "the of"), (None, "word other"), (5, "word")]))
    queries = spark.createDataFrame([(1, "word"), (2, None)], "query_id long, text string")
    got = {(r.query_id, r.rank): r.doc_id for r in block_max.search(index, queries, 2).collect()}
    assert got[1, 1] == 5 and len(got) == 4
    assert segments.RANGE_DOCS > 1


def test_search_exchanges_postings_of_query_terms_only(spark):
    """Records that the search over texts writes to shuffles, against the postings of query terms."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(1).cache()
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway
    all_stages = lambda: [s for s in (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))]
    index = bm25.build(docs)
    postings = index.postings.join(bm25._wanted(queries), "term", "left_semi").count()
    last = max(s.stageId() for s in all_stages())
    bm25.search(docs, queries, 10).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = max(s.shuffleWriteRecords() for s in all_stages() if s.stageId() > last)
    assert postings <= sent < postings + 500 and index.postings.count() > 50 * postings


def sent_records(spark, run):
    """Records that ``run`` writes to shuffles, all stages together."""
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway
    found = lambda: (lambda all_: [all_.apply(i) for i in range(all_.size())])(store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))
    spark.range(1).repartition(2).collect()
    last = max(s.stageId() for s in found())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteRecords() for s in found() if s.stageId() > last)


def test_postings_are_not_exchanged(spark, tmp_path):
    """An index and a search send terms, thresholds and documents that can win, never postings."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(90))) for i in range(1500)]
    index, docs = Segments(spark, str(tmp_path / "i")), frame(spark, rows).coalesce(1)
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} w3") for i in range(20)], "query_id long, text string")
    assert sent_records(spark, lambda: index.add(docs)) < 1000
    assert sent_records(spark, lambda: index.delete(docs.where("doc_id % 7 = 0").select("doc_id"))) < 5000
    assert sent_records(spark, lambda: block_max.search(index, queries, 3).collect()) < 5000
    assert rows_of(block_max.search(index, queries, 3)) == rows_of(bm25.search(docs.where("doc_id % 7 <> 0"), queries, 3))


def test_small_batches_ranges_and_joins_give_the_same(spark, tmp_path, monkeypatch):
    rows = made(200)
    docs, queries = frame(spark, rows), asked(spark, rows, 10)
    monkeypatch.setattr(segments, "BROADCAST_GONE", 0)
    monkeypatch.setattr(block_max, "PAIRS", 30)
    monkeypatch.setattr(block_max, "HELD", 20)
    for piece, of_range in ((300, 90), (1, 1)):
        monkeypatch.setattr(segments, "PIECE", piece)
        monkeypatch.setattr(segments, "RANGE_POSTINGS", of_range)
        index = Segments(spark, str(tmp_path / f"i{piece}"))
        index.add(docs)
        index.delete(docs.where("doc_id % 5 = 0").select("doc_id"))
        assert rows_of(block_max.search(index, queries, 4)) == rows_of(bm25.search(docs.where("doc_id % 5 <> 0"), queries, 4))


def test_purged_segments_are_gone_and_their_numbers_are_not_used_again(spark, tmp_path):
    rows = made(60)
    index = Segments(spark, str(tmp_path / "i"))
    index.add(frame(spark, rows[:30]))
    index.add(frame(spark, rows[30:]))
    last = index.compact()
    before = sorted(map(tuple, index.terms().collect()))
    index.purge()
    assert [p.name for p in (tmp_path / "i" / "blocks").iterdir()] == [f"segment={last}"]
    assert sorted(map(tuple, index.terms().collect())) == before
    assert index.add(frame(spark, [(100, "new")])) == last + 1 and index.totals()[0] == 61
