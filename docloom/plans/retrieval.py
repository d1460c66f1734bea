"""Queries for sparse, dense and hybrid retrieval, routing, dedup."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import bitmaps, block_max, bm25, cells, chat_flow, dense, retrieval
from docloom.operators.segments import Segments
from docloom.sources.tables import load, scratch

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, sf_dir):
    return bm25.search(load(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), 10)


def bm25_filtered_topk(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return bm25.search(docs, _queries(spark, sf_dir), 3, (F.col("source") == "src3") & (F.col("lang") == "en"))


def bm25_term_stats(spark, sf_dir):
    return bm25.term_stats(bm25.build(load(spark, sf_dir, "documents").select("doc_id", "text")))


def bm25_doc_len(spark, sf_dir):
    return bm25.doc_lengths(load(spark, sf_dir, "documents"))


def metadata_posting_sets(spark, sf_dir):
    return bm25.posting_sets(load(spark, sf_dir, "documents"), "source")


_TOKENS = f"""tok as (select doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents),
post as (select doc_id, any_value(source) as source, any_value(lang) as lang, term, count(*) as tf from tok where term not in ({STOP_SQL}) group by doc_id, term)"""


def _bm25_sql(k: int, where: str) -> str:
    return f"""with {_TOKENS},
len as (select d.doc_id, coalesce(sum(p.tf), 0) as dl from documents d left join post p using (doc_id) group by d.doc_id),
tot as (select count(*) as n, avg(dl) as avgdl from len),
df as (select term, count(*) as df from post group by term),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from benchmark) group by query_id, term),
sc as (select q.query_id, p.doc_id, sum(q.qtf * ln(1.0 + (tot.n - df.df + 0.5) / (df.df + 0.5)) * p.tf / (p.tf + 1.5 * (1 - 0.75 + 0.75 * len.dl / tot.avgdl))) as score
  from post p join df using (term) join q using (term) join len on len.doc_id = p.doc_id cross join tot group by q.query_id, p.doc_id),
pairs as (select b.item_id as query_id, d.doc_id from benchmark b cross join documents d where {where}),
al as (select pairs.query_id, pairs.doc_id, round(coalesce(sc.score, 0.0), 6) as score from pairs left join sc on sc.query_id = pairs.query_id and sc.doc_id = pairs.doc_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from al)
select query_id, cast(rank as bigint) as rank, doc_id, score from r where rank <= {k}"""


def bm25_index_topk(spark, sf_dir):
    """The search of bm25_topk over an index of the first and the second half of the documents, merged."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.col("doc_id") % 2 == 0
    return bm25.search_index(bm25.build(bm25.merged(docs.where(half), docs.where(~half))), _queries(spark, sf_dir), 10)


def bm25_keys_topk(spark, sf_dir):
    """Two of three keys given, so the internal documents are asked with both and the user's store is not."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    wanted = {"source": "src3", "lang": "en", "doc": None}
    found = bm25.search(docs, _queries(spark, sf_dir), 3, bm25.keys_filter(wanted))
    return found.withColumn("user_store", F.lit(bm25.all_given(wanted)))


def bm25_blockmax_topk(spark, sf_dir):
    """The search of bm25_topk by score bounds, over an index of one segment."""
    index = Segments(spark, scratch(spark, "segments"))
    index.add(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return block_max.search(index, _queries(spark, sf_dir), 10)


def _changed_index(spark, sf_dir) -> Segments:
    """Documents come in two segments; every seventh goes; of these every other one comes again; all is compacted and every eleventh goes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = Segments(spark, scratch(spark, "segments"))
    for part in (F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 != 0):
        index.add(docs.where(part))
    index.delete(docs.where("doc_id % 7 = 0"))
    index.add(docs.where("doc_id % 14 = 0"))
    index.compact()
    index.purge()
    index.delete(docs.where("doc_id % 11 = 0"))
    return index


def bm25_segments_topk(spark, sf_dir):
    """Search by score bounds after additions, deletions and a compaction."""
    return block_max.search(_changed_index(spark, sf_dir), _queries(spark, sf_dir), 10)


def bm25_segments_stats(spark, sf_dir):
    """Term statistics of the same index, as sums over its segments."""
    return bm25.term_stats(_changed_index(spark, sf_dir).index())


KEY_SETS = {"source": {"source": "src3"}, "lang": {"lang": "en"}, "both": {"source": "src3", "lang": "en"}, "none": {"source": None, "lang": None}, "unknown": {"source": "src3", "lang": "xx"}}


def bitmap_members(spark, sf_dir):
    """Documents of subsets of keys, from posting sets as bitmaps."""
    sets = bitmaps.posting_sets(load(spark, sf_dir, "documents"), ["source", "lang"])
    found = [bitmaps.members(bitmaps.intersection(sets, keys)).select(F.lit(name).alias("keys"), "doc_id") for name, keys in KEY_SETS.items()]
    return functools.reduce(DataFrame.unionByName, found)


def bitmap_pair_counts(spark, sf_dir):
    """How many documents each source has in each language, without a look at the documents again."""
    return bitmaps.pair_counts(bitmaps.posting_sets(load(spark, sf_dir, "documents"), ["source", "lang"]), "source", "lang")


def exact_dedup_first_wins(spark, sf_dir):
    return retrieval.first_occurrence(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source")


# --- dense: as queries, every vector whose id is divisible by 20 --------------


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


def _vector_queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, sf_dir):
    return dense.search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


def dense_cells_topk(spark, sf_dir):
    """The search of dense_topk by bounds of cells."""
    return cells.top(cells.find(cells.build(_vectors(spark, sf_dir)), _vector_queries(spark, sf_dir), 10), 10)


def dense_filtered_topk(spark, sf_dir):
    return dense.search(_vectors(spark, sf_dir).where("label = 3"), _vector_queries(spark, sf_dir), 10)


def template_top1(spark, sf_dir):
    return dense.search(_vectors(spark, sf_dir).where("label = 0"), _vector_queries(spark, sf_dir), 1)


def _l2(where: str, k: int) -> str:
    return f"""with q as (select vec_id as query_id, embedding from embeddings where vec_id % 20 = 0),
d as (select q.query_id, e.vec_id, round(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: (e.embedding[i]::double - q.embedding[i]::double) * (e.embedding[i]::double - q.embedding[i]::double))), 6) as distance
  from q cross join embeddings e where {where}),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, cast(rank as bigint) as rank, vec_id, distance from r where rank <= {k}"""


def route_queries(spark, sf_dir):
    """Utterances: the vectors of label 0 (knowledge base) and 1 (templates) that are no queries."""
    utterances = _vectors(spark, sf_dir).where("label in (0, 1) and vec_id % 20 <> 0").withColumn("route", F.when(F.col("label") == 0, "knowledge_base").otherwise("template_doc"))
    return dense.route(utterances, _vector_queries(spark, sf_dir))


_ROUTE_SQL = """with q as (select vec_id as query_id, embedding from embeddings where vec_id % 20 = 0),
u as (select vec_id, case when label = 0 then 'knowledge_base' else 'template_doc' end as route, embedding from embeddings where label in (0, 1) and vec_id % 20 <> 0),
d as (select q.query_id, u.vec_id, u.route, round(1 - list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(u.embedding, lambda x: x::double)), 6) as distance from q cross join u),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as n from d),
m as (select query_id, route, round(avg(1 - distance), 5) as score from r where n <= 5 group by query_id, route),
b as (select *, row_number() over (partition by query_id order by score desc, route) as n from m)
select query_id, case when score >= 0.5 then route end as route, score from b where n = 1"""


# --- hybrid: query i is benchmark item i with vector i; document i has vector i ---


def _lists(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    queries = _queries(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).join(docs.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    asked = queries.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    user = F.col("source") == "src3"
    as_docs = lambda df: df.withColumnRenamed("vec_id", "doc_id")
    lists = {
        "dense_internal": as_docs(dense.search(vectors, asked, 10)),
        "dense_user": as_docs(dense.search(vectors.where(user), asked, 10)),
    } | bm25.search_lists(docs, queries, 10, {"bm25_internal": None, "bm25_user": user})
    return docs, queries, retrieval.union_lists(lists)


def retrieval_debug(spark, sf_dir):
    return _lists(spark, sf_dir)[2].select("query_id", "src", "rank", "doc_id")


def hybrid_union_dedup(spark, sf_dir):
    docs, _, lists = _lists(spark, sf_dir)
    return retrieval.first_wins(lists, docs).select("query_id", "src", "rank", "doc_id")


def hybrid_rerank_top3(spark, sf_dir):
    docs, queries, lists = _lists(spark, sf_dir)
    return retrieval.rerank(retrieval.first_wins(lists, docs), queries).select("query_id", "final_rank", "doc_id", "src", "rerank_score")


def _lists_sql() -> str:
    dense_part = """select q.item_id as query_id, e.vec_id as doc_id, d.source, round(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: (e.embedding[i]::double - v.embedding[i]::double) * (e.embedding[i]::double - v.embedding[i]::double))), 6) as distance
  from benchmark q join embeddings v on v.vec_id = q.item_id cross join embeddings e join documents d on d.doc_id = e.vec_id"""
    return f"""dd as ({dense_part}),
l0 as (select query_id, 'dense_internal' as src, 0 as src_ord, row_number() over (partition by query_id order by distance, doc_id) as rank, doc_id from dd),
l1 as (select query_id, 'dense_user' as src, 1 as src_ord, row_number() over (partition by query_id order by distance, doc_id) as rank, doc_id from dd where source = 'src3'),
l2 as (select query_id, 'bm25_internal' as src, 2 as src_ord, rank, doc_id from ({_bm25_sql(10, "true")})),
l3 as (select query_id, 'bm25_user' as src, 3 as src_ord, rank, doc_id from ({_bm25_sql(10, "d.source = 'src3'")})),
lists as (select * from l0 where rank <= 10 union all select * from l1 where rank <= 10 union all select * from l2 union all select * from l3),
dedup as (select lists.*, t.text, row_number() over (partition by query_id, t.text order by src_ord, rank, lists.doc_id) as n from lists join documents t on t.doc_id = lists.doc_id)"""


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_RERANK_SQL = f"""with {_lists_sql()},
s as (select dedup.*, case when len(list_distinct({_WORDS.format('b.text')})) > 0 then round(len(list_intersect(list_distinct({_WORDS.format('b.text')}), list_distinct({_WORDS.format('dedup.text')})))::double / len(list_distinct({_WORDS.format('b.text')})), 6) else 0.0 end as rerank_score
  from dedup join benchmark b on b.item_id = dedup.query_id where n = 1),
r as (select *, row_number() over (partition by query_id order by rerank_score desc, src_ord, rank, doc_id) as final_rank from s)
select query_id, cast(final_rank as bigint) as final_rank, doc_id, src, rerank_score from r where final_rank <= 3"""


def chat_answer(spark, sf_dir):
    """Every benchmark passage as a question, with the vector of its number."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    questions = _queries(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = questions.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    out = chat_flow.answer(questions, docs, vectors, asked, F.col("source") == "src3")
    return out.select("query_id", "gate", "decision", "needs_retry", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.length("prompt").cast("long").alias("prompt_chars"))


QUERIES = {f.__name__: f for f in (chat_answer, bm25_topk, bm25_filtered_topk, bm25_index_topk, bm25_keys_topk, bm25_blockmax_topk, bm25_segments_topk, bm25_segments_stats, bitmap_members, bitmap_pair_counts, bm25_term_stats, bm25_doc_len, metadata_posting_sets, exact_dedup_first_wins, dense_topk, dense_cells_topk, dense_filtered_topk, template_top1, route_queries, retrieval_debug, hybrid_union_dedup, hybrid_rerank_top3)}

_ANSWER_SQL = _RERANK_SQL[: _RERANK_SQL.rindex("select query_id, cast(final_rank")] + f"""select b.item_id as query_id, 'pass' as gate, coalesce(z.decision, 'FALLBACK') as decision, coalesce(z.decision = 'RETRY', false) as needs_retry,
  coalesce(z.chunk_ids, '') as chunk_ids, z.prompt_chars
from benchmark b join (
  select query_id, decision, case when decision = 'FALLBACK' then '' else string_agg(doc_id::varchar, ',' order by rerank_score desc, final_rank) filter (where used) end as chunk_ids,
    case when decision = 'FALLBACK' then {len(chat_flow.judge.FALLBACK_MESSAGE)} else
      cast(sum(length('<chunk id="1">      <source_metadata>        Chunk Id:       </source_metadata>      <content>              </content>    </chunk>') + 7 + length(doc_id::varchar)
        + length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) filter (where used) + 2 * (count(*) filter (where used) - 1) as bigint) end as prompt_chars
  from (select *, case when decision = 'PASS' then rerank_score >= 0.78 else rerank_score >= 0.5 and rerank_score < 0.78 end as used from (
    select *, case when max(rerank_score) over (partition by query_id) >= 0.78 then 'PASS' when max(rerank_score) over (partition by query_id) >= 0.5 then 'RETRY' else 'FALLBACK' end as decision
    from r where final_rank <= 3)) group by query_id, decision) z on z.query_id = b.item_id"""


def _live_sql(sql: str) -> str:
    """``sql`` over the documents that _changed_index leaves."""
    return "with live as (select * from documents where (doc_id % 7 <> 0 or doc_id % 14 = 0) and doc_id % 11 <> 0), " + sql.removeprefix("with ").replace("from documents", "from live").replace("join documents", "join live")


_TERM_STATS_SQL = f"with {_TOKENS} select term, count(*) as df, round(ln(1.0 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from post group by term"

ORACLE_SQL = {
    "bm25_topk": _bm25_sql(10, "true"),
    "bm25_filtered_topk": _bm25_sql(3, "d.source = 'src3' and d.lang = 'en'"),
    "bm25_index_topk": _bm25_sql(10, "true"),
    "bm25_keys_topk": f"select *, false as user_store from ({_bm25_sql(3, "d.source = 'src3' and d.lang = 'en'")})",
    "bm25_term_stats": _TERM_STATS_SQL,
    "bitmap_members": """select 'source' as keys, doc_id from documents where source = 'src3' union all select 'lang', doc_id from documents where lang = 'en'
union all select 'both', doc_id from documents where source = 'src3' and lang = 'en' union all select 'none', doc_id from documents""",
    "bitmap_pair_counts": "select source as first, lang as second, count(*) as n_docs from documents where source <> '' and lang <> '' group by source, lang",
    "bm25_blockmax_topk": _bm25_sql(10, "true"),
    "bm25_segments_topk": _live_sql(_bm25_sql(10, "true")),
    "bm25_segments_stats": _live_sql(_TERM_STATS_SQL),
    "bm25_doc_len": f"with {_TOKENS} select d.doc_id, cast(coalesce(sum(p.tf), 0) as bigint) as dl from documents d left join post p using (doc_id) group by d.doc_id",
    "metadata_posting_sets": "select source as value, count(*) as n_docs, min(doc_id) as first_doc, max(doc_id) as last_doc from documents where source is not null and source <> '' group by source",
    "exact_dedup_first_wins": "select doc_id, source from (select doc_id, source, row_number() over (partition by coalesce(text, '') order by doc_id) as n from documents) where n = 1",
    "dense_topk": _l2("true", 10),
    "dense_cells_topk": _l2("true", 10),
    "dense_filtered_topk": _l2("e.label = 3", 10),
    "template_top1": _l2("e.label = 0", 1),
    "route_queries": _ROUTE_SQL,
    "retrieval_debug": f"with {_lists_sql()} select query_id, src, cast(rank as bigint) as rank, doc_id from lists",
    "hybrid_union_dedup": f"with {_lists_sql()} select query_id, src, cast(rank as bigint) as rank, doc_id from dedup where n = 1",
    "hybrid_rerank_top3": _RERANK_SQL,
    "chat_answer": _ANSWER_SQL,
}
