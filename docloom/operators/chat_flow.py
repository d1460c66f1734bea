"""A batch of questions from gate to prompt, as one lazily built plan.

gate -> route -> hybrid retrieval -> re-rank -> judge -> decision -> prompt.  Each
question keeps its ``query_id`` through all steps; model calls are functions from
columns to columns with offline defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import app, bm25, dense, guardrail, judge, quota, retrieval

REFUSAL = "Please rephrase the query toward a legal question."


@dataclass(frozen=True)
class Models:
    gate: Callable[[Column], Column] = guardrail.keyword_gate
    rerank: Callable[[Column, Column], Column] = retrieval.overlap_score
    #: struct<relevant, supports_answer, chunk_type_match, score> of a chunk, from its re-rank score
    judge: Callable[[Column], Column] = lambda s: F.struct((s >= 0.2).alias("relevant"), (s >= 0.5).alias("supports_answer"), F.lit(True).alias("chunk_type_match"), s.alias("score"))


def candidates(docs: DataFrame, questions: DataFrame, vectors: DataFrame, question_vectors: DataFrame, owned: Column | None = None, k: int = 10) -> DataFrame:
    """Fused result lists; the user's lists only where ``owned`` (user, knowledge base and document all given) selects documents."""
    named = lambda df: df.withColumnRenamed("vec_id", "doc_id")
    lists = {"dense_internal": named(dense.search(vectors, question_vectors, k))}
    lists |= bm25.search_lists(docs, questions, k, {"bm25_internal": None} | ({"bm25_user": owned} if owned is not None else {}))
    if owned is not None:
        mine = docs.where(owned).select(F.col("doc_id").alias("vec_id"))
        lists["dense_user"] = named(dense.search(vectors.join(mine, "vec_id", "left_semi"), question_vectors, k))
    return retrieval.first_wins(retrieval.union_lists(lists), docs)


def judged(asked: DataFrame, docs: DataFrame, vectors: DataFrame, question_vectors: DataFrame, owned: Column | None = None, models: Models = Models()) -> DataFrame:
    """query_id, decision, used (chunk_id and text of the chunks that the decision leaves) of questions that found any."""
    found = retrieval.rerank(candidates(docs, asked, vectors, question_vectors, owned), asked, 3, models.rerank)
    found = found.join(asked.select("query_id"), "query_id", "left_semi")
    verdict = models.judge(F.col("rerank_score"))
    chunk = F.struct(F.col("final_rank"), F.col("doc_id").cast("string").alias("chunk_id"), verdict["relevant"].alias("relevant"), verdict["supports_answer"].alias("supports_answer"),
                     verdict["chunk_type_match"].alias("chunk_type_match"), verdict["score"].alias("score"), F.col("text"))
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunk_results"), F.max("rerank_score").alias("confidence"))  # three chunks at most
    used = F.when(F.col("decision") == "PASS", F.col("final_chunks")).when(F.col("decision") == "RETRY", F.col("retry_chunks"))
    return judge.evaluate(rows).select("query_id", "decision", F.transform(used, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("used"))


def _context(used: Column) -> Column:
    shown = F.transform(used, lambda c, i: app.formatted_chunk(i + 1, F.array(F.struct(F.lit("chunk_id").alias("key"), c["chunk_id"].alias("value"))), c["text"]))
    return F.array_join(shown, "\n\n")


def _gated(questions: DataFrame, models: Models) -> DataFrame:
    return questions.withColumn("gate", F.coalesce(models.gate(F.col("text")), F.lit("pass")))


def answer(questions: DataFrame, docs: DataFrame, vectors: DataFrame, question_vectors: DataFrame, owned: Column | None = None, models: Models = Models()) -> DataFrame:
    """query_id, gate, decision, needs_retry, chunk_ids, prompt for each of ``questions`` (query_id, text).

    A blocked question has no decision and the refusal as its prompt; one without
    passages is FALLBACK with the fixed sentence.
    """
    gated = _gated(questions, models)
    blocked = guardrail.blocks(F.col("gate"))
    found = judged(gated.where(~blocked).select("query_id", "text"), docs, vectors, question_vectors, owned, models)
    out = gated.select("query_id", "gate").join(found, "query_id", "left")
    return out.select(
        "query_id", "gate",
        F.when(~blocked, F.coalesce("decision", F.lit("FALLBACK"))).alias("decision"),
        F.coalesce(F.col("decision") == "RETRY", F.lit(False)).alias("needs_retry"),
        F.coalesce(F.transform("used", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("chunk_ids"),
        F.when(blocked, REFUSAL).otherwise(F.coalesce(_context(F.col("used")), F.lit(judge.FALLBACK_MESSAGE))).alias("prompt"),
    )


#: Where the context of an answer comes from.
KNOWLEDGE, TEMPLATE, EXTERNAL, NOTHING = "knowledge_base", "template_doc", "external", "none"


def converse(
    questions: DataFrame, routes: DataFrame, docs: DataFrame, vectors: DataFrame, question_vectors: DataFrame, templates: DataFrame,
    external: DataFrame, histories: DataFrame, owned: Column | None = None, models: Models = Models(),
) -> DataFrame:
    """query_id, gate, route, decision, origin, chunk_ids, prompt: the whole flow for a batch of questions.

    By its route (query_id, route) a question goes to the knowledge base and the
    judge, to the nearest of ``templates`` (vec_id, embedding), or nowhere.  What the
    judge sends to FALLBACK takes the chunks of an external search (query_id,
    position, doc_id, content), if there are any.  The prompt holds the history
    (query_id, history), the context and the question; without context the context
    is the fixed sentence, and of a blocked question the prompt is the refusal.
    """
    gated = _gated(questions, models).join(routes.select("query_id", "route"), "query_id", "left")
    blocked = guardrail.blocks(F.col("gate"))
    asked = gated.where(~blocked)
    of = lambda name: asked.where(F.col("route") == name).select("query_id", "text")
    chunk = lambda key, text: F.struct(key.cast("string").alias("chunk_id"), text.alias("text"))
    known = of(KNOWLEDGE).select("query_id").join(judged(of(KNOWLEDGE), docs, vectors, question_vectors, owned, models), "query_id", "left").withColumn("decision", F.coalesce("decision", F.lit("FALLBACK")))
    near = dense.search(templates, question_vectors.join(of(TEMPLATE), "query_id", "left_semi"), 1)
    patterns = near.join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("query_id", F.array(chunk(F.col("vec_id"), F.col("text"))).alias("pattern"))
    outside = external.join(known.where("decision = 'FALLBACK'").select("query_id"), "query_id", "left_semi")
    outside = outside.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", chunk(F.col("doc_id"), F.col("content")).alias("c")))).alias("hits"))  # the first hits of a search
    outside = outside.select("query_id", F.transform("hits", lambda h: h["c"]).alias("hits"))
    out = gated
    for part in (known, outside, patterns, histories.select("query_id", "history")):
        out = out.join(part, "query_id", "left")
    origin = F.when(F.col("used").isNotNull(), KNOWLEDGE).when(F.col("hits").isNotNull(), EXTERNAL).when(F.col("pattern").isNotNull(), TEMPLATE).otherwise(NOTHING)
    out = out.withColumn("origin", origin).withColumn("used", F.coalesce("used", "hits", "pattern"))
    parts = F.array(F.coalesce("history", F.lit(app.NO_HISTORY)), F.coalesce(_context(F.col("used")), F.lit(judge.FALLBACK_MESSAGE)), F.concat(F.lit("Question: "), F.coalesce("text", F.lit(""))))
    return out.select(
        "query_id", "gate", "route", "decision", "origin",
        F.coalesce(F.transform("used", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("chunk_ids"),
        F.when(blocked, REFUSAL).otherwise(F.array_join(parts, "\n\n")).alias("prompt"),
    )


def chat_events(turns: DataFrame, models: Models = Models()) -> DataFrame:
    """Quota events of chats (event_id, user_id, ts, query, tokens): each reserves a fixed amount and is settled to its tokens, or to nothing if the gate blocks it."""
    settle = F.when(guardrail.blocks(models.gate(F.col("query"))), -quota.RESERVED_FOR_CHAT).otherwise(F.col("tokens") - quota.RESERVED_FOR_CHAT)
    return turns.select("event_id", "user_id", "ts", F.lit("reserve").alias("kind"), F.lit(quota.RESERVED_FOR_CHAT).alias("amount"), settle.alias("settle"))
