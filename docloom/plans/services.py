"""Queries for rules, sources and sinks, sessions, parsing and the composed question flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import app, bm25, chat_flow, guardrail, judge, quota, structure
from docloom.plans import documents, retrieval
from docloom.sources import tables, vector_sink
from docloom.sources.tables import load

# --- rules ---------------------------------------------------------------------


def judge_violations(spark, sf_dir):
    """A verdict for each labelled document, with faults by its number."""
    d = F.col("doc_id")
    raw = F.to_json(
        F.struct(
            F.when(d % 3 == 0, " ").otherwise("q").alias("query"), F.when(d % 4 == 0, "RETRY").otherwise("PASS").alias("overall_decision"), (d % 7 / 5.0).alias("confidence"),
            F.when(d % 8 == 0, "why").otherwise("").alias("retry_reason"),
            F.when(d % 5 != 0, F.array(F.struct(F.when(d % 2 == 0, "").otherwise("c").alias("chunk_id"), ((d % 11) / 8.0).alias("score"), F.when(d % 13 == 0, " ").otherwise("r").alias("reason")))).alias("chunk_results"),
        )
    )
    rows = load(spark, sf_dir, "labels").select("doc_id", judge.parse(raw).alias("v"))
    return rows.select("doc_id", F.array_join(judge.violations(F.col("v")), "; ").alias("violations"))


def scores_rounded_at_halves(spark, sf_dir):
    """Scores such as 0.00015, which are halves as decimal text and a little more or less as doubles."""
    half = (2 * F.col("n_chars") + 1) / F.lit(20000.0)
    return load(spark, sf_dir, "documents").select("doc_id", judge.rounded(half).alias("score"))


def scores_rounded(spark, sf_dir):
    """Scores at four digits, halves to the even digit."""
    return load(spark, sf_dir, "documents").select("doc_id", judge.rounded(F.col("n_chars") % 64 / 32.0).alias("score"))


def signup_rejections(spark, sf_dir):
    """Customers who sign up: some with short names or passwords, malformed or taken addresses."""
    key = F.col("c_custkey")
    signups = load(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 7 == 0, "Al").otherwise(F.col("c_name")).alias("name"), F.when(key % 5 == 0, "broken").otherwise(F.concat(F.lit("u"), key.cast("string"), F.lit("@x.org"))).alias("email"),
        F.repeat(F.lit("p"), (key % 9).cast("int")).alias("password"),
    )
    users = signups.where("c_custkey % 11 = 0").select("email")
    return app.rejected_signups(signups, users).select("c_custkey", F.array_join("reasons", "; ").alias("reasons"))


def layout_items(spark, sf_dir):
    """Lines of documents as layout items, every third a footnote, every fourth a citation."""
    lines = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    items = lines.select("doc_id", "ord", F.when(F.col("ord") % 3 == 0, "footnote").otherwise("text").alias("label"), F.when(F.col("ord") % 4 == 0, "3 A v B, AIR 1950").otherwise(F.col("line")).alias("text"))
    return items.select("doc_id", F.col("ord").cast("long").alias("ord"), structure.with_page_tag(structure.footnote_item_text(F.col("label"), F.col("text")), F.col("ord") % 10 + 1).alias("text"))


def markdown_tables(spark, sf_dir):
    """The nations of each region as a table of two columns, one name with a line break."""
    row = F.array(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 5 == 0, None).otherwise(F.concat(F.lit(" a\n"), "n_name")))
    rows = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("cells")))).alias("rows"))
    return rows.select("n_regionkey", app.table_markdown(F.transform("rows", lambda r: r["cells"])).alias("table"))


def gate_answers(spark, sf_dir):
    """A gate model's answers: tags in other case, missing, empty."""
    k = F.col("item_id")
    raw = F.concat(F.when(k % 3 == 0, "<GATE> Pass </gate>").when(k % 3 == 1, "<gate>FAIL</gate>").otherwise("<gate>maybe</gate>"), F.when(k % 2 == 0, F.concat(F.lit("<response> "), "text", F.lit(" </response>"))).otherwise("<Response>x</Response>"),
                   F.when(k % 5 == 0, "<reasoning></reasoning>").otherwise(""))
    parsed = guardrail.parse(raw)
    return load(spark, sf_dir, "benchmark").select("item_id", parsed["gate"].alias("gate"), parsed["response"].alias("response"), parsed["reasoning"].alias("reasoning"))


def default_kb(spark, sf_dir):
    """Knowledge base and document of each event, where some name none."""
    k = F.col("event_id")
    kb, doc = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("kb"), (k % 7).cast("string"))), F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("d"), k.cast("string")))
    chosen = app.default_kb(kb, doc)
    return load(spark, sf_dir, "events").select("event_id", chosen["kb"].alias("kb"), chosen["doc"].alias("doc"))


def response_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"), "event_type")
    return app.shaped(rows)


def toc_wrapped(spark, sf_dir):
    """Answers of a model that is asked for a table of contents: a list, an object, a fenced object, the object for none."""
    k = F.col("item_id")
    one = F.concat(F.lit('{"BLOCK '), k.cast("string"), F.lit('": {"section": ["A"]}}'))
    raw = F.when(k % 4 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k % 4 == 1, one).when(k % 4 == 2, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise('{"error": "no table of contents"}')
    return load(spark, sf_dir, "benchmark").select("item_id", F.trim(F.replace(app.toc_of(F.lit(""), lambda _: raw), F.lit("\n"), F.lit(""))).alias("toc"))


# --- sessions ------------------------------------------------------------------


def session_titles(spark, sf_dir):
    """Sessions of all conversations and some that nobody wrote in."""
    messages = load(spark, sf_dir, "conversations").where("conv_id % 5 <> 0")
    return app.session_titles(load(spark, sf_dir, "conversations").select("conv_id").distinct(), messages)


def logged_messages(spark, sf_dir):
    """Messages that are logged where the gate blocks every seventh."""
    return app.logged_messages(load(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 7 == 0)


def audit_gated(spark, sf_dir):
    """Audit rows of conversations that name both a knowledge base and a document (two in three of every two)."""
    rows = app.audit(load(spark, sf_dir, "conversations")).withColumns({"kb": F.when(F.col("conv_id") % 2 == 0, "kb"), "doc": F.when(F.col("conv_id") % 3 != 0, "doc")})
    return rows.where("kb is not null and doc is not null").select("conv_id", "turn", F.length("response").cast("long").alias("response_chars"))


# --- sources and sinks -----------------------------------------------------------


def parsed_pages(spark, sf_dir):
    """Pages as files of three pages each: the text, a short one, and bytes that are no text in every ninth file."""
    k = F.col("page_id")
    content = F.concat(F.encode(F.concat("html", F.lit("\f"), F.substring("html", 1, 20), F.lit("\f"), "url"), "UTF-8"), F.when(k % 9 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    found = tables.parsed_pages(load(spark, sf_dir, "pages").select("page_id", content.alias("content")), "page_id")
    return found.select("page_id", "page_no", "method", F.length("text").cast("long").alias("n_chars"), F.split("error", ":")[0].alias("error"))


def kb_paths(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tables.kb_path(F.col("source"), F.col("doc_id")).alias("path"))


def vector_table(spark, sf_dir):
    """Chunks appended twice to the vector table and restored: each once, without empty ones."""
    path = tables.scratch(spark, "vectors")
    rows = load(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("kb_document_id"), F.lit(1).alias("chunk_no"), F.col("text").alias("content"))
    for _ in range(2):
        tables.append_vectors(rows, path)
    return tables.restore_vectors(spark, path).select(F.col("kb_document_id").cast("long").alias("doc_id"), "collection", F.length("content").cast("long").alias("n_chars"))


def vector_commits(spark, sf_dir):
    """Documents and benchmark passages appended to the vector table by commits, the first repeated under its name; its rows as they are restored."""
    path = tables.scratch(spark, "commits")
    row = lambda key, collection: (collection.alias("collection"), key.cast("string").alias("kb_document_id"), F.lit(1).alias("chunk_no"), F.col("text").alias("content"))
    docs = load(spark, sf_dir, "documents").select(*row(F.col("doc_id"), F.coalesce("lang", F.lit(""))))
    items = load(spark, sf_dir, "benchmark").select(*row(-1 - F.col("item_id"), F.lit("benchmark")))
    for rows, commit in ((docs, "documents"), (items, "benchmark"), (docs, "documents")):
        vector_sink.append(rows, path, commit)
    return vector_sink.restore(spark, path).select(F.col("kb_document_id").cast("long").alias("id"), "collection", F.length("content").cast("long").alias("n_chars"))


def json_files(spark, sf_dir):
    """Benchmark items written as JSON and read again."""
    path = tables.scratch(spark, "json")
    tables.write_json(load(spark, sf_dir, "benchmark"), path)
    return spark.read.schema("item_id bigint, text string").json(path)


def saved_index_topk(spark, sf_dir):
    """BM25 from an index that was saved and read."""
    path = tables.scratch(spark, "index")
    bm25.build(load(spark, sf_dir, "documents").select("doc_id", "text")).write(path)
    if not bm25.index_exists(spark, path):
        raise FileNotFoundError(path)
    return bm25.search_index(bm25.Index.read(spark, path), retrieval._queries(spark, sf_dir), 10)


# --- flow ------------------------------------------------------------------------


def _external(spark, sf_dir):
    """Pages as recorded answers of a search: page i is hit i // 40 of query i % 40, two in three being fragments."""
    pages, k = load(spark, sf_dir, "pages"), F.col("page_id")
    hits = pages.select((k % 40).alias("query_id"), F.floor(k / 40).cast("int").alias("position"), k.alias("tid"), (k % 3 != 1).alias("fragment"), F.lit("court").alias("docsource"), F.lit("2020-01-01").alias("publishdate"))
    fragments = pages.where("page_id % 11 <> 0").select(k.alias("tid"), F.array(F.lit("<b>seen</b> at"), F.col("url")).alias("headline"), F.col("url").alias("title"))
    return tables.external_chunks(hits, fragments)


def external_fallback(spark, sf_dir):
    return _external(spark, sf_dir).select("query_id", F.col("position").cast("long").alias("position"), "doc_id", "content", "url")


def chat_flow_full(spark, sf_dir):
    """Every benchmark passage as a question, by route: knowledge base, template, none in turn; the history is the conversation of its number."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    questions = retrieval._queries(spark, sf_dir)
    k = F.col("query_id")
    routes = questions.select("query_id", F.when(k % 4 < 2, chat_flow.KNOWLEDGE).when(k % 4 == 2, chat_flow.TEMPLATE).alias("route"))
    every = load(spark, sf_dir, "embeddings")
    vectors = every.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = questions.join(every.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    histories = app.history(load(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    external = _external(spark, sf_dir).where("query_id % 5 <> 0")
    out = chat_flow.converse(questions, routes, docs, vectors, asked, vectors.where("vec_id % 10 = 3"), external, histories, F.col("source") == "src3")
    return out.select("query_id", "gate", "route", "decision", "origin", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.length("prompt").cast("long").alias("prompt_chars"))


def chat_quota_flow(spark, sf_dir):
    """Purchases as chats: one in five asks what the gate blocks, the others cost 300 and their value."""
    events = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    turns = events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 == 0, "a joke").otherwise("a lease").alias("query"), (F.floor("value").cast("long") + 300).alias("tokens"))
    out = quota.fold(chat_flow.chat_events(turns))
    return out.select("user_id", "event_id", "admitted", "day_used", quota.left(F.col("day_used"), quota.CHAT_TOKENS.daily).cast("long").alias("left"))


def kb_extraction(spark, sf_dir):
    """Chunks of the layout lines by the whole chain, as rows of the vector table; figures of each document."""
    lines = documents._layout(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    items = lines.select("doc_id", "ord", F.lit("text").alias("label"), "text", (F.floor(F.col("ord") / 40) + 1).cast("int").alias("page"))
    rows = structure.payload(structure.extracted(items, documents.TOC), F.lit(1), F.lit("kb"))
    return rows.groupBy("kb_document_id").agg(F.count("*").alias("n_chunks"), F.max("page_number").alias("last_page"), F.bool_and(~F.col("content").contains("@@")).alias("untagged"))


QUERIES = {
    f.__name__: f
    for f in (
        judge_violations, scores_rounded, scores_rounded_at_halves, signup_rejections, layout_items, markdown_tables, gate_answers, default_kb, response_rows, toc_wrapped, session_titles, logged_messages, audit_gated,
        parsed_pages, kb_paths, vector_table, vector_commits, json_files, saved_index_topk, external_fallback, chat_flow_full, chat_quota_flow, kb_extraction,
    )
}

_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_N = "len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}'))"
_EXTERNAL_SQL = """select page_id % 40 as query_id, cast(page_id // 40 as bigint) as position, page_id as doc_id, 'seen at ' || url as content, 'https://example.org/doc/' || page_id || '/' as url
from pages where page_id // 40 < 3 and page_id % 3 <> 1 and page_id % 11 <> 0"""
_CHUNK_CHARS = "length('<chunk id=\"1\">      <source_metadata>        Chunk Id:       </source_metadata>      <content>              </content>    </chunk>') + 7"


def _flow_sql() -> str:
    kb = retrieval._ANSWER_SQL[: retrieval._ANSWER_SQL.rindex("select b.item_id")]
    inner = retrieval._ANSWER_SQL[retrieval._ANSWER_SQL.index("select query_id, decision, case when decision = 'FALLBACK'") : retrieval._ANSWER_SQL.rindex(") z on")]
    history = application_history()
    return f"""{kb.rstrip()}, z as ({inner}),
hist as ({history}),
ex as (select query_id, string_agg(doc_id::varchar, ',' order by position) as ids, cast(sum({_CHUNK_CHARS} + length(doc_id::varchar) + length(content)) + 2 * (count(*) - 1) as bigint) as chars from ({_EXTERNAL_SQL}) where query_id % 5 <> 0 group by query_id),
near as (select query_id, doc_id, text from (select dd.query_id, dd.doc_id, t.text, row_number() over (partition by query_id order by distance, dd.doc_id) as n from dd join documents t on t.doc_id = dd.doc_id where dd.doc_id % 10 = 3) where n = 1),
q as (select item_id as query_id, text, case when item_id % 4 < 2 then 'knowledge_base' when item_id % 4 = 2 then 'template_doc' end as route from benchmark),
a as (select q.*, case when route = 'knowledge_base' then coalesce(z.decision, 'FALLBACK') end as decision, z.chunk_ids as kb_ids, z.prompt_chars as kb_chars, ex.ids as ex_ids, ex.chars as ex_chars, near.doc_id as near_id, near.text as near_text
  from q left join z using (query_id) left join ex using (query_id) left join near using (query_id)),
b as (select *, case when route = 'knowledge_base' and decision <> 'FALLBACK' then 'knowledge_base' when decision = 'FALLBACK' and ex_ids is not null then 'external' when route = 'template_doc' and near_id is not null then 'template_doc' else 'none' end as origin from a)
select b.query_id, 'pass' as gate, route, decision, origin, case origin when 'knowledge_base' then kb_ids when 'external' then ex_ids when 'template_doc' then near_id::varchar else '' end as chunk_ids,
  cast(length(coalesce(hist.history, '{app.NO_HISTORY}')) + 4 + length('Question: ') + length(text)
    + case origin when 'knowledge_base' then kb_chars when 'external' then ex_chars when 'template_doc' then {_CHUNK_CHARS} + length(near_id::varchar) + length({_STRIPPED.format('near_text')}) else {len(judge.FALLBACK_MESSAGE)} end as bigint) as prompt_chars
from b left join hist on hist.conv_id = b.query_id"""


def application_history() -> str:
    from docloom.plans import application

    return application.ORACLE_SQL["chat_history_last5"]


ORACLE_SQL = {
    "judge_violations": """select doc_id, array_to_string(list_filter([case when doc_id % 3 = 0 then 'query is blank' end, case when doc_id % 5 = 0 then 'no chunk results' end, case when doc_id % 7 / 5.0 > 1 then 'confidence outside 0 to 1' end,
  case when doc_id % 4 = 0 and doc_id % 8 <> 0 then 'retry reason is missing' end, case when doc_id % 5 <> 0 and doc_id % 2 = 0 then 'chunk id is blank' end, case when doc_id % 5 <> 0 and doc_id % 13 = 0 then 'reason is blank' end,
  case when doc_id % 5 <> 0 and doc_id % 11 / 8.0 > 1 then 'score outside 0 to 1' end], lambda x: x is not null), '; ') as violations from labels""",
    "scores_rounded_at_halves": "select doc_id, cast(printf('%.4f', (2 * n_chars + 1) / 20000.0::double) as double) as score from documents",
    "scores_rounded": "select doc_id, round_even(n_chars % 64 / 32.0::double, 4)::double as score from documents",
    "signup_rejections": """with s as (select c_custkey, case when c_custkey % 7 = 0 then 'Al' else c_name end as name, case when c_custkey % 5 = 0 then 'broken' else 'u' || c_custkey || '@x.org' end as email, c_custkey % 9 as n from customer)
select c_custkey, array_to_string(list_filter([case when n < 6 then 'password is too short' end, case when length(name) < 3 then 'name is too short' end, case when email = 'broken' then 'email is malformed' end,
  case when email in (select email from s where c_custkey % 11 = 0) then 'email is taken' end], lambda x: x is not null), '; ') as reasons from s""",
    "layout_items": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents where text is not null),
i as (select doc_id, ord, case when ord % 4 = 0 then case when ord % 3 = 0 then '' else '3 A v B, AIR 1950' end when ord % 3 = 0 and regexp_matches({_STRIPPED.format('line')}, '(?is){structure.FOOTNOTE_ITEM}') then '' else line end as text from l)
select doc_id, cast(ord as bigint) as ord, case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 3 then {_STRIPPED.format('text')} || ' @@PAGE_' || (ord % 10 + 1) || '@@' else text end as text from i""",
    "markdown_tables": """with r as (select n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || case when n_nationkey % 5 = 0 then '' else 'a ' || n_name end || ' |' as line, row_number() over (partition by n_regionkey order by n_nationkey) as n from nation)
select n_regionkey, string_agg(line || case when n = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by n) as "table" from r group by n_regionkey""",
    "gate_answers": f"select item_id, case item_id % 3 when 0 then 'pass' when 1 then 'fail' end as gate, case when item_id % 2 = 0 then {_STRIPPED.format('text')} end as response, case when item_id % 5 = 0 then '' end as reasoning from benchmark",
    "default_kb": "select event_id, case when event_id % 2 = 0 and event_id % 3 = 0 then 'internal' when event_id % 2 = 0 then '' else 'kb' || (event_id % 7) end as kb, case when event_id % 3 <> 0 then 'd' || event_id end as doc from events",
    "response_rows": "select event_id::varchar as event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, case when user_id % 4 <> 0 then user_id::varchar end as user_id, event_type from events",
    "toc_wrapped": """select item_id, case when item_id % 4 = 3 then '{"error": "no table of contents"}' else '[{"BLOCK ' || item_id || '": {"section": ["A"]}}]' end as toc from benchmark""",
    "session_titles": f"""with f as (select conv_id, arg_min(text, turn) as query from conversations where conv_id % 5 <> 0 and role = 'user' and text is not null group by conv_id)
select c.conv_id, case when f.query is null then '{app.NEW_SESSION}' else array_to_string(regexp_split_to_array(replace(trim(f.query), '"', ''), '\\s+')[1:5], ' ') end as title from (select distinct conv_id from conversations) c left join f using (conv_id)""",
    "logged_messages": f"""with m as (select *, {_N} as n from conversations),
h as (select *, coalesce(sum(n) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding), 0) as history from m)
select conv_id, turn, role, cast(n + case when role = 'user' then history else 0 end as bigint) as tokens from h where not (role = 'user' and (conv_id + turn) % 7 = 0)""",
    "audit_gated": "with p as (select *, lead(role) over w as next_role, lead(text) over w as response from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, length(response) as response_chars from p where role = 'user' and next_role = 'assistant' and conv_id % 2 = 0 and conv_id % 3 <> 0",
    "parsed_pages": f"""with p as (select page_id, html || chr(12) || left(html, 20) || chr(12) || url as t from pages), x as (select page_id, unnest(string_split(t, chr(12))) as text, generate_subscripts(string_split(t, chr(12)), 1) as page_no from p where page_id % 9 <> 0)
select page_id, cast(page_no as bigint) as page_no, case when length({_STRIPPED.format('text')}) > 50 then 'digital' else 'ocr' end as method, case when length({_STRIPPED.format('text')}) > 50 then length(text) else 0 end as n_chars, case when length({_STRIPPED.format('text')}) <= 50 then 'ValueError' end as error from x
union all select page_id, 1, 'failed', 0, 'UnicodeDecodeError' from pages where page_id % 9 = 0""",
    "kb_paths": "select doc_id, source || '/' || doc_id || '.pdf' as path from documents",
    "vector_table": "select doc_id, lang as collection, length(text) as n_chars from documents where text is not null and text <> ''",
    "vector_commits": "select doc_id as id, coalesce(lang, '') as collection, length(text) as n_chars from documents where text <> '' union all select -1 - item_id, 'benchmark', length(text) from benchmark where text <> ''",
    "json_files": "select item_id, text from benchmark",
    "saved_index_topk": retrieval._bm25_sql(10, "true"),
    "external_fallback": _EXTERNAL_SQL,
    "chat_flow_full": _flow_sql(),
    "chat_quota_flow": f"""with recursive e as (select user_id, event_id, case when event_id % 5 = 0 then 0 else floor(value)::bigint + 300 end as cost, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'purchase'),
r as (select user_id, n, event_id, day, month, true as admitted, cost as day_used, cost as month_used from e where n = 1
  union all
  select user_id, n, event_id, day, month, ok, d + case when ok then cost else 0 end, m + case when ok then cost else 0 end from (
    select *, d + {quota.RESERVED_FOR_CHAT} <= {quota.CHAT_TOKENS.daily} and m + {quota.RESERVED_FOR_CHAT} <= {quota.CHAT_TOKENS.monthly} as ok from (
      select e.user_id, e.n, e.event_id, e.day, e.month, e.cost, case when r.day = e.day then r.day_used else 0 end as d, case when r.month = e.month then r.month_used else 0 end as m
      from r join e on e.user_id = r.user_id and e.n = r.n + 1)))
select user_id, event_id, admitted, cast(day_used as bigint) as day_used, cast(greatest(0, {quota.CHAT_TOKENS.daily} - day_used) as bigint) as "left" from r""",
}
