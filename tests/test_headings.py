"""Rules as a table for each document, against the literal rules of ``structure.with_hierarchy`` document by document."""

import random

import pytest

from pyspark.sql import functions as F

from docloom.operators import headings, structure

BLOCKS = "doc_id long, ord int, name string, chapters array<string>, sections array<string>, subs array<string>"
TITLES = ["OFFER", "CHAPTER I", "1. Definition", "Counter-offer", "Of the Court", "12", "Section (a)", "Civil Law", "a.b", "é", "Café Law", "[x] y", "K", "Mild", "offer and acceptance", "CHAPTER II", "i", "M.D."]
PIECES = ["offer", "Offerings", "CHAPTER  I", "chapter ii", "1 . definition", "IVcivil law", "XMILD", "Counter - offer: it", "counter—offers", "of the  court.", "12", "7", "  12 ", "section (a) x", "a . b c", "É", "CAFÉ LAW -", "[x]   y", "K", "the K", "5 [1 . Definition", "word civil law", "iii. offer", "ofﬁce", "oﬀer", "Sectıon (a)", "plain body", "", "m.d.", "(( offer", "two words offer"]


@pytest.mark.parametrize("few", [0, 32])
def test_like_literal_rules(spark, monkeypatch, few):
    monkeypatch.setattr(headings, "FEW", few)
    r = random.Random(8)
    texts, tables, expected = [], [], {}
    for doc in range(40):
        blocks = [{r.choice(TITLES + [""]): {"chapter heading": r.sample(TITLES, r.randrange(0, 3)), "section": r.sample(TITLES, r.randrange(0, 3)), "sub section": r.sample(TITLES, r.randrange(0, 2))}} for _ in range(r.randrange(1, 4))]
        text = "\n".join(" ".join(r.choice(PIECES) for _ in range(r.choice([1, 1, 1, 2]))) for _ in range(25))
        texts.append((doc, text))
        for at, block in enumerate(blocks):
            for name, b in block.items():
                tables.append((doc, at, name, b["chapter heading"], b["section"], b["sub section"]))
        rules = structure.heading_rules(blocks)
        if doc < 8 and rules:
            expected[doc] = structure.with_hierarchy(spark.createDataFrame([(doc, text)], "doc_id long, text string"), rules).first().text
    docs = spark.createDataFrame(texts + [(100, None), (101, "7\nno rules\n\nx"), (102, "")], "doc_id long, text string").repartition(3)
    found = headings.rules_of(spark.createDataFrame(tables, BLOCKS))
    got = {x.doc_id: x.text for x in headings.with_hierarchy(docs, found).collect()}
    assert len(got) == 43 and got[100] is None and got[101] == "no rules\n\nx" and got[102] == ""
    assert {d: got[d] for d in expected} == expected
    # no rule that matches is missed by its anchor: all rules of a document on all its lines
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    met = lines.join(found.withColumn("pattern", headings.pattern(F.col("title"))), "doc_id").withColumn("s", F.trim("line")).where(F.expr("s <> '' and s rlike pattern"))
    best = {(x.doc_id, x.line_no): x.title for x in met.groupBy("doc_id", "line_no").agg(F.min_by("title", "ord").alias("title")).collect()}
    assert best == {(x.doc_id, x.line_no): x.title for x in headings.matched_lines(docs, found).where("level is not null").collect()} and len(best) > 300


def test_a_thousand_documents_in_one_plan(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("Intro%d\nPart%d body\n\nPart%d other\n%d", F.col("id"), F.col("id"), F.col("id"), F.col("id") % 10).alias("text"))
    blocks = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.format_string("Book %d", F.col("id")).alias("name"), F.array(F.format_string("Part%d", F.col("id"))).alias("chapters"), F.lit(None).cast("array<string>").alias("sections"), F.lit(None).cast("array<string>").alias("subs"))
    got = {r.doc_id: r.text for r in headings.with_hierarchy(docs, headings.rules_of(blocks)).collect()}
    assert got == {i: f"Intro{i}\n# @@H1@@ Book {i}\n## @@H2@@ Part{i}\nbody\n\n## @@H2@@ Part{i}\nother" for i in range(1000)}
