"""Hybrid retrieval: ordered union of result lists, first-wins dedup, re-rank, dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.stored import stored

#: Order of the lists in the union.
SOURCES = ("dense_internal", "dense_user", "bm25_internal", "bm25_user")


def union_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """query_id, src, src_ord, rank, doc_id of result lists (query_id, rank, doc_id), in the order of SOURCES."""
    parts = [lists[s].select("query_id", F.lit(s).alias("src"), F.lit(i).alias("src_ord"), "rank", "doc_id") for i, s in enumerate(SOURCES) if s in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Spark 4.1 takes a union of lists that are each dealt by query_id as dealt so, too, though it has as many partitions
    # as all of them, and fails to join it; the lists are short, so they are dealt anew by other keys
    return out.repartition("query_id", "doc_id")


def first_wins(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results joined with their texts; of equal texts of a query the first in list order stays.

    Results are stored first, so that Spark knows their size: short lists go to the texts and no text of another document is exchanged.
    """
    content = docs.select("doc_id", "text").join(stored(results, "results"), "doc_id").select(*results.columns, "text")
    order = Window.partitionBy("query_id", "text").orderBy("src_ord", "rank", "doc_id")
    return content.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def overlap_score(query: Column, text: Column) -> Column:
    """Default re-rank score: share of the query's distinct words that the text has."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, T.words(text))) / F.size(q), 6)).otherwise(F.lit(0.0))


def rerank(results: DataFrame, queries: DataFrame, k: int = 3, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The k best of each query by ``scorer(query text, document text)``; ties keep the list order."""
    scored = results.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").withColumn("rerank_score", scorer(F.col("query_text"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "src_ord", "rank", "doc_id")
    return scored.withColumn("final_rank", F.row_number().over(order).cast("long")).where(F.col("final_rank") <= k)


def first_occurrence(docs: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows whose content no earlier row has.

    One row for each content reaches the join: contents are grouped on the map
    side, by a 256-bit digest instead of the text.
    """
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    first = keyed.groupBy("__digest").agg(F.min(order).alias(order))
    return keyed.join(first, ["__digest", order], "left_semi").drop("__digest")


def dispatch(routes: DataFrame, knowledge: DataFrame, template: DataFrame) -> DataFrame:
    """Results of each query by its route (query_id, route): knowledge base, template, or none."""
    kb = knowledge.join(routes.where("route = 'knowledge_base'").select("query_id"), "query_id", "left_semi")
    return kb.unionByName(template.join(routes.where("route = 'template_doc'").select("query_id"), "query_id", "left_semi"))
