"""Queries for judging, chat, quota, metadata, catalog and upload rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import app, guardrail, judge, quota
from docloom.sources.tables import load

# --- judge: a source is a query, its labelled documents are the judged chunks ---
# relevant = quality, type match = not toxic, score and support by fixed arithmetic of n_chars


def _verdicts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id")
    chunk = F.struct(
        F.col("doc_id"),
        (F.col("quality") == 1).alias("relevant"),
        (F.col("n_chars") % 3 != 0).alias("supports_answer"),
        ((F.col("n_chars") % 100) / 100.0).alias("score"),
        (F.col("toxic") == 0).alias("chunk_type_match"),
    )
    return docs.groupBy("source").agg(F.array_sort(F.collect_list(chunk)).alias("chunk_results"), ((F.sum("n_chars") % 101) / 100.0).alias("confidence"))


def judge_decide(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("source", judge.decide(F.col("confidence"), F.col("chunk_results")).alias("decision"))


def judge_final_chunks(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select("source", F.posexplode(judge.final_chunks(F.col("chunk_results"))).alias("i", "c"))
    return rows.select("source", (F.col("i") + 1).cast("long").alias("place"), "c.doc_id", "c.score")


def judge_retry_chunks(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select("source", F.posexplode(judge.retry_chunks(F.col("chunk_results"))).alias("i", "c"))
    return rows.select("source", (F.col("i") + 1).cast("long").alias("place"), "c.doc_id", "c.score")


def judge_evaluate(spark, sf_dir):
    out = judge.evaluate(_verdicts(spark, sf_dir))
    return out.select("source", "decision", F.size("final_chunks").cast("long").alias("n_final"), F.size("retry_chunks").cast("long").alias("n_retry"), "fallback_message")


def collect_final_chunks(spark, sf_dir):
    approved = _verdicts(spark, sf_dir).select(F.col("source").alias("query_id"), F.explode(judge.final_chunks(F.col("chunk_results"))).alias("c")).select("query_id", "c.doc_id")
    results = load(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "lang")
    return judge.collect_final(results, approved)


_CHUNKS = """c as (select d.source, d.doc_id, l.quality = 1 as relevant, d.n_chars % 3 <> 0 as supports, (d.n_chars % 100) / 100.0::double as score, l.toxic = 0 as typed, d.n_chars from documents d join labels l using (doc_id)),
v as (select * from c where relevant and typed)"""
_DECIDED = f"""{_CHUNKS},
s as (select source, (sum(n_chars) % 101) / 100.0::double as confidence from c group by source),
g as (select s.source, confidence, count(v.doc_id) as n, count(case when v.supports then 1 end) as sup, coalesce(max(v.score), 0.0) as top from s left join v on v.source = s.source group by s.source, confidence),
dec as (select source, case when confidence >= 0.78 and n >= 1 and sup >= 1 and top >= 0.78 then 'PASS' when confidence >= 0.5 or top >= 0.5 then 'RETRY' else 'FALLBACK' end as decision from g)"""

# --- chat ----------------------------------------------------------------------


def _messages(spark, sf_dir):
    return load(spark, sf_dir, "conversations")


def chat_history_last5(spark, sf_dir):
    return app.history(_messages(spark, sf_dir))


def message_list(spark, sf_dir):
    """Messages whose conversation belongs to a known user: conversation i to customer i."""
    owners = load(spark, sf_dir, "customer")
    return app.with_owner(_messages(spark, sf_dir), owners, "conv_id", "c_custkey").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def session_list(spark, sf_dir):
    first = _messages(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), F.count("*").alias("n_messages"))
    return first.select("conv_id", F.array_join(F.slice(F.split(T.clean_title(F.col("opening")), r"\s+"), 1, 5), " ").alias("title"), "n_messages")


def session_stats(spark, sf_dir):
    return _messages(spark, sf_dir).agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"), F.coalesce(F.bool_or(F.col("role") == "system"), F.lit(False)).alias("has_system"))


def audit_rows(spark, sf_dir):
    rows = app.audit(_messages(spark, sf_dir))
    return rows.select("conv_id", "turn", F.length("query").cast("long").alias("query_chars"), F.length("response").cast("long").alias("response_chars"))


def token_usage(spark, sf_dir):
    n = F.size(T.words(F.coalesce("text", F.lit(""))))
    return _messages(spark, sf_dir).groupBy("conv_id").agg(F.sum(n).cast("long").alias("tokens"))


# --- quota: signup is an upload, purchase a reservation, error an adjustment ------


def quota_upload_admission(spark, sf_dir):
    events = load(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return quota.admit_units(events).select("event_id", "user_id", "admitted")


def quota_daily_usage(spark, sf_dir):
    events = load(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("amount", F.floor(F.col("value")).cast("long"))
    return quota.usage(events)


def quota_chat_fold(spark, sf_dir):
    events = load(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    kind = F.when(F.col("event_type") == "purchase", "reserve").otherwise("adjust")
    amount = F.when(F.col("event_type") == "purchase", F.lit(quota.RESERVED_FOR_CHAT)).otherwise(F.floor(F.col("value")).cast("int") - 200)
    return quota.fold(events.select("event_id", "user_id", "ts", kind.alias("kind"), amount.alias("amount")))


def quota_left(spark, sf_dir):
    used = quota_daily_usage(spark, sf_dir)
    return used.select("user_id", "day", quota.left(F.col("used"), quota.CHAT_TOKENS.daily).cast("long").alias("left"))


# --- catalog -----------------------------------------------------------------


def user_docs_semijoin(spark, sf_dir):
    users = load(spark, sf_dir, "customer")
    return app.with_owner(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), users, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


def fk_join_user_docs(spark, sf_dir):
    orders, users, nations = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(users, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_documents"), F.countDistinct("c_custkey").alias("n_users"))


def doc_status_latest(spark, sf_dir):
    log = load(spark, sf_dir, "events").withColumn("key", F.struct("ts", "event_id"))
    return app.latest(log, "user_id", "key", "event_type").select("user_id", F.col("event_type").alias("status"))


def find_or_create_kb(spark, sf_dir):
    """Knowledge bases are the nations; wanted are one for each source of the documents."""
    existing = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(False).alias("created"))
    wanted = load(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().withColumn("created", F.lit(True))
    return app.find_or_create(existing, wanted, "name")


def backfill_default(spark, sf_dir):
    """Labels of every document; those without one get a constant."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


# --- metadata, prompts, uploads, gate ----------------------------------------------


def metadata_sanitize(spark, sf_dir):
    """Metadata of each document as a map of lists, one of them empty and one null."""
    none = F.lit(None).cast("array<string>")
    m = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("lang", "source", "both", "empty", "missing")]),
        F.array(F.array("lang"), F.array("source"), F.array("lang", "source"), F.array().cast("array<string>"), none),
    )
    clean = app.sanitised(m)
    return load(spark, sf_dir, "documents").select("doc_id", F.size(clean).cast("long").alias("n_entries"), clean["both"].alias("both_values"))


def format_chunks(spark, sf_dir):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("source_file", F.col("source")), ("score", F.lit("1")), ("page_number", F.col("doc_id") % 7), ("chapter_title", F.lit(None)))])
    return load(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") + 1).alias("n"), F.lit("kb").alias("source"), F.col("item_id").alias("doc_id"), "text").select("item_id", app.formatted_chunk(F.col("n"), entries, F.col("text")).alias("chunk"))


def prompt_context(spark, sf_dir):
    """The passages of each benchmark decade in one context, a blank line between."""
    rows = load(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 10).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("c"))
    return rows.select("batch", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("context"))


def upload_validation(spark, sf_dir):
    """Each page as an upload: its size, its name (by its number) and its first characters."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".PDF", ".tar.pdf", ".txt", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    head = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.substring("html", 1, 8))
    size = F.length("html").cast("long") * 700
    v = app.upload_verdict(F.concat(F.lit("file"), suffix), size, head)
    return load(spark, sf_dir, "pages").select("page_id", v["code"].alias("code"), v["reason"].alias("reason"))


def guardrail_gate(spark, sf_dir):
    """The gate on every message, some of which are given a topic by their number."""
    topics = ("Is a cheque bounce a crime? ", "best cooking recipes ", "a joke about bail ", "", "weather today ")
    topic = F.element_at(F.array(*[F.lit(t) for t in topics]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return _messages(spark, sf_dir).select("conv_id", "turn", guardrail.keyword_gate(F.concat(topic, F.coalesce("text", F.lit("")))).alias("gate"))


def kv_extract_parties(spark, sf_dir):
    """Extraction records (one of a customer's two parties, fenced) parsed and exploded."""
    raw = F.concat(F.lit('```json\n{"parties_involved": [{"entity_name": "'), "c_name", F.lit('", "legal_role": "Buyer", "entity_type": "Individual"}, {"entity_name": "Store", "legal_role": "Seller", "entity_type": "Corporation"}], "critical_dates": []}\n```'))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.posexplode(app.extraction(raw)["parties_involved"]).alias("i", "p"))
    return rows.select("c_custkey", F.col("i").cast("long").alias("place"), "p.entity_name", "p.legal_role")


QUERIES = {
    f.__name__: f
    for f in (
        judge_decide, judge_final_chunks, judge_retry_chunks, judge_evaluate, collect_final_chunks, chat_history_last5, message_list, session_list, session_stats,
        audit_rows, token_usage, quota_upload_admission, quota_daily_usage, quota_chat_fold, quota_left, user_docs_semijoin, fk_join_user_docs, doc_status_latest,
        find_or_create_kb, backfill_default, metadata_sanitize, format_chunks, prompt_context, upload_validation, guardrail_gate, kv_extract_parties,
    )
}

_WORD_RE = "[\\p{L}\\p{N}_]{2,}"
_FINAL = f"with {_CHUNKS} select source, cast(row_number() over (partition by source order by score desc, doc_id) as bigint) as place, doc_id, score from v where "
_GATE = lambda topics: "(^|[^a-z0-9])(" + "|".join(topics) + ")s?([^a-z0-9]|$)"

ORACLE_SQL = {
    "judge_decide": f"with {_DECIDED} select source, decision from dec",
    "judge_final_chunks": _FINAL + "supports and score >= 0.78",
    "judge_retry_chunks": _FINAL + "score >= 0.5 and score < 0.78",
    "judge_evaluate": f"""with {_DECIDED} select dec.source, decision, (select count(*) from v where v.source = dec.source and supports and score >= 0.78) as n_final,
(select count(*) from v where v.source = dec.source and score >= 0.5 and score < 0.78) as n_retry, case when decision = 'FALLBACK' then '{judge.FALLBACK_MESSAGE}' end as fallback_message from dec""",
    "collect_final_chunks": f"with {_CHUNKS} select d.source as query_id, d.doc_id, d.lang from documents d where exists (select 1 from v where v.source = d.source and v.doc_id = d.doc_id and v.supports and v.score >= 0.78)",
    "chat_history_last5": f"""with r as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations),
h as (select conv_id, trim(string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || coalesce(text, ''), chr(10) || chr(10) order by turn), ' ' || chr(9) || chr(10) || chr(13)) as history from r where n <= 5 group by conv_id)
select conv_id, case when history = '' then '{app.NO_HISTORY}' else history end as history from h""",
    "message_list": "select conv_id, turn, role, length(text) as n_chars from conversations where conv_id in (select c_custkey from customer)",
    "session_list": "with f as (select conv_id, arg_min(text, turn) as opening, count(*) as n_messages from conversations group by conv_id) select conv_id, array_to_string(regexp_split_to_array(replace(trim(opening), '\"', ''), '\\s+')[1:5], ' ') as title, n_messages from f",
    "session_stats": "select count(distinct conv_id) as sessions, count(*) as messages, coalesce(bool_or(role = 'system'), false) as has_system from conversations",
    "audit_rows": "with p as (select *, lead(role) over w as next_role, lead(text) over w as response from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, length(text) as query_chars, length(response) as response_chars from p where role = 'user' and next_role = 'assistant'",
    "token_usage": f"select conv_id, cast(sum(len(regexp_extract_all(lower(coalesce(text, '')), '{_WORD_RE}'))) as bigint) as tokens from conversations group by conv_id",
    "quota_upload_admission": """with e as (select event_id, user_id, ts, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month from events where event_type = 'signup'),
d as (select *, row_number() over (partition by user_id, day order by ts, event_id) <= 2 as in_day from e)
select event_id, user_id, in_day and sum(in_day::int) over (partition by user_id, month order by ts, event_id rows unbounded preceding) <= 30 as admitted from d""",
    "quota_daily_usage": "select user_id, strftime(ts, '%Y-%m-%d') as day, cast(sum(floor(value)::bigint) as bigint) as used from events where event_type = 'purchase' group by 1, 2",
    "quota_chat_fold": """with recursive e as (select user_id, event_id, event_type = 'error' as adjust, case when event_type = 'purchase' then 600 else floor(value)::bigint - 200 end as amount,
  strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('purchase', 'error')),
r as (select user_id, n, event_id, day, month, adjust or amount <= 1000 as admitted, case when adjust or amount <= 1000 then amount else 0 end as day_used, case when adjust or amount <= 1000 then amount else 0 end as month_used from e where n = 1
  union all
  select user_id, n, event_id, day, month, ok, d + case when ok then amount else 0 end, m + case when ok then amount else 0 end from (
    select *, adjust or (d + amount <= 1000 and m + amount <= 20000) as ok from (
      select e.user_id, e.n, e.event_id, e.day, e.month, e.adjust, e.amount, case when r.day = e.day then r.day_used else 0 end as d, case when r.month = e.month then r.month_used else 0 end as m
      from r join e on e.user_id = r.user_id and e.n = r.n + 1)))
select user_id, event_id, admitted, cast(day_used as bigint) as day_used, cast(month_used as bigint) as month_used from r""",
    "quota_left": "select user_id, strftime(ts, '%Y-%m-%d') as day, cast(greatest(0, 1000 - sum(floor(value)::bigint)) as bigint) as \"left\" from events where event_type = 'purchase' group by 1, 2",
    "user_docs_semijoin": "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer)",
    "fk_join_user_docs": "select n_name, count(*) as n_documents, count(distinct c_custkey) as n_users from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "doc_status_latest": "select user_id, arg_max(event_type, (ts, event_id)) as status from events group by user_id",
    "find_or_create_kb": "select n_name as name, false as created from nation union all select distinct source, true from documents where source not in (select n_name from nation)",
    "backfill_default": "select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id)",
    "metadata_sanitize": "select doc_id, 3::bigint as n_entries, lang || ', ' || source as both_values from documents",
    "format_chunks": "select item_id, '<chunk id=\"' || (item_id + 1) || '\">' || chr(10) || '      <source_metadata>' || chr(10) || '        Source File: kb' || chr(10) || '    Page Number: ' || (item_id % 7) || chr(10) || '      </source_metadata>' || chr(10) || '      <content>' || chr(10) || '        ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '      </content>' || chr(10) || '    </chunk>' as chunk from benchmark",
    "prompt_context": "select item_id // 10 as batch, string_agg(text, chr(10) || chr(10) order by item_id) as context from benchmark group by 1",
    "upload_validation": """with u as (select page_id, page_id % 5 as s, length(html) * 700 as size, case when page_id % 3 = 0 then '%PDF-1.7' else left(html, 8) end as head from pages)
select page_id, case when size > 2097152 then 413 when s = 2 then 400 when s not in (0, 1) then 400 when not starts_with(head, '%PDF-') then 400 else 0 end as code,
case when size > 2097152 then 'too large' when s = 2 then 'double extension' when s not in (0, 1) then 'not a .pdf name' when not starts_with(head, '%PDF-') then 'not a PDF' else 'accepted' end as reason from u""",
    "guardrail_gate": f"""with m as (select conv_id, turn, lower(['Is a cheque bounce a crime? ', 'best cooking recipes ', 'a joke about bail ', '', 'weather today '][(conv_id + turn) % 5 + 1] || coalesce(text, '')) as q from conversations)
select conv_id, turn, case when regexp_matches(q, '{_GATE(guardrail.Topics().allowed)}') then 'pass' when regexp_matches(q, '{_GATE(guardrail.Topics().refused)}') then 'fail' else 'pass' end as gate from m""",
    "kv_extract_parties": "select c_custkey, 0::bigint as place, c_name as entity_name, 'Buyer' as legal_role from customer union all select c_custkey, 1, 'Store', 'Seller' from customer",
}
