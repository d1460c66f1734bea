"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, byte_bpe, chat_format, decontaminate, exact_dedup, importance_sample, license_scan, quality_rules, sharding, simhash_dedup, source_audit, substring_dedup, token_alignment
from .shared import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, "doc_id").withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_sample.resample(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    turns = chat_format.assemble(rows.unionByName(extra), RANKS, public_tokenizers.PATTERN)
    return chat_format.read_back(turns, RANKS, public_tokenizers.PATTERN)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("digest", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_importance_sample": op4_importance_sample,
    "op5_attention_lm": op5_attention_lm,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_audit": op12_source_audit,
    "op13_exact_dedup": op13_exact_dedup,
}


def _escaped(column: str, pattern: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '({pattern})', '\\\\\\1', 'g')"


#: The operators whose results plain SQL can state; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || {_escaped('role', '[\\\\:]|###|</turn>')} || ': ' || {_escaped('text', '[\\\\]|###|</turn>')} || '</turn>' || chr(10))) as bigint) as formatted_chars
from c group by conv_id""",
    "op8_substring_dedup": """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as s from w, unnest(generate_series(1, len(ws) - 12)) as t(i)),
f as (select s, min(doc_id) as first_doc from g group by s),
r as (select distinct doc_id, i + k as pos from g join f using (s), generate_series(0, 12) as o(k) where first_doc < doc_id),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
y as (select x.doc_id, count(*) as n_words, count(r.pos) as n_removed, coalesce(string_agg(word, ' ' order by x.pos) filter (where r.pos is null), '') as kept from x left join r on r.doc_id = x.doc_id and r.pos = x.pos group by x.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join y using (doc_id)""",
    "op12_source_audit": """with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
o as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from o group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
t as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
p as (select t.lang, t.source, kept.term, coalesce(c.n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)::hugeint) // (t.total::hugeint + 5 * v.v::hugeint) as bigint) as p
  from t join kept on kept.lang = t.lang join v on v.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
whole as (select lang, sum(total) as total from t group by lang),
q as (select p.lang, p.term, cast(1 + (1000000000::hugeint * (sum(n)::hugeint + 5)) // (any_value(whole.total)::hugeint + 5 * any_value(v.v)::hugeint) as bigint) as q from p join whole on whole.lang = p.lang join v on v.lang = p.lang group by p.lang, p.term),
f as (select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
rows as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from rows)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50""",
    "op13_exact_dedup": """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
}
