"""Queries for text structure, HTML, personal data and chunks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.functions.tokens import Vocabulary
from docloom.operators import headings, names, privacy, structure
from docloom.sources import tables
from docloom.sources.tables import load


def html_clean(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def pii_detect(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.detect(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.label", "e.value", F.col("e.pos").cast("long").alias("pos"))


def pii_mask(spark, sf_dir):
    return privacy.mask_documents(load(spark, sf_dir, "documents")).select("doc_id", "masked", F.size("pairs").cast("long").alias("n_pairs"))


def pii_restore(spark, sf_dir):
    return privacy.mask_documents(load(spark, sf_dir, "documents")).select("doc_id", "restored")


#: The word before the number of a mailbox.
MAILBOX = r"([\p{L}]+)\.[0-9]+@"


def _names(spark, sf_dir):
    """Names that the tables hold: mailboxes of documents, the surer the more documents they stand in, and how benchmark passages begin."""
    boxes = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(MAILBOX), F.lit(1))).alias("name"))
    n = F.count_distinct("doc_id")
    persons = boxes.groupBy("name").agg((n / (n + 1)).alias("score")).select("name", F.lit("PERSON").alias("label"), "score")
    words = F.split("text", " ")
    companies = load(spark, sf_dir, "benchmark").where(F.size(words) >= 3).select(F.array_join(F.slice(words, 1, 3), " ").alias("name"), F.lit("COMPANY").alias("label"), F.lit(0.9).alias("score"))
    return persons.unionByName(companies)


def names_by_document(spark, sf_dir):
    """Names of all mailboxes and benchmark passages in every document: how many of each kind, their characters and places."""
    found = names.detect(load(spark, sf_dir, "documents").select("doc_id", "text"), _names(spark, sf_dir))
    of = lambda label: F.size(F.filter("found", lambda e: e["label"] == label)).cast("long")
    total = lambda number: F.reduce("found", F.lit(0).cast("long"), lambda n, e: n + number(e))
    return found.select("doc_id", of("PERSON").alias("n_persons"), of("COMPANY").alias("n_companies"), total(lambda e: F.length(e["value"])).alias("n_chars"), total(lambda e: e["pos"]).alias("places"))


def toc_page_ranges(spark, sf_dir):
    """Bookmarks: a document's lines as entries, two in three of level 1, a page being 400 characters."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("ord", "title"))
    at = F.sum(F.length("title") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    marks = lines.select(
        F.col("doc_id").alias("doc"), "ord", F.when(F.col("ord") % 3 == 1, 2).otherwise(1).alias("level"), "title",
        (F.floor(F.coalesce(at, F.lit(0)) / 400) + 1).alias("start_page"), (F.floor(F.col("n_chars") / 400) + 1).alias("page_count"),
    )
    return structure.page_ranges(marks).select("doc", F.col("ord").cast("long").alias("ord"), "start_page", "end_page")


def page_methods(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tables.page_method(T.html_text(F.col("html"))).alias("method"))


def chunk_previews(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def _layout(spark, sf_dir):
    """Documents as scanned law text: a synopsis on top, page tags, a footnote, headings."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    first = F.get(F.split("text", "\n"), F.lit(0))
    text = F.concat(F.lit("Synopsis\n| "), first, F.lit(" |\n|---|\nentry one\n"), F.col("text"), F.lit("\n5 [1 . Definition - body @@PAGE_1@@\n12. A v B, AIR 1950 @@PAGE_2@@\n12\nend"))
    return docs.select("doc_id", text.alias("text"))


def synopsis_removed(spark, sf_dir):
    return _layout(spark, sf_dir).select("doc_id", structure.without_synopsis(F.col("text")).alias("text"))


def footnotes_removed(spark, sf_dir):
    return _layout(spark, sf_dir).select("doc_id", structure.without_footnotes(F.col("text")).alias("text"))


TOC = [{"CHAPTER I": {"chapter heading": "OFFER", "section": ["1. Definition", "The of"], "sub section": ["Entry-one"]}}]


def hierarchy_fixed(spark, sf_dir):
    return structure.with_hierarchy(_layout(spark, sf_dir), structure.heading_rules(TOC))


def hierarchy_by_document(spark, sf_dir):
    """Each document has a table of contents of its own: the first four words of four letters or more are its book, chapter, section and sub section."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    word = lambda i: F.get(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1)), F.lit(i))
    blocks = docs.select("doc_id", F.lit(0).alias("ord"), word(0).alias("name"), F.array(word(1)).alias("chapters"), F.array(word(2)).alias("sections"), F.array(word(3)).alias("subs"))
    return headings.with_hierarchy(docs, headings.rules_of(blocks))


def template_headers(spark, sf_dir):
    marked = F.regexp_replace("text", "(?m)^(?=The)", "## ")
    return load(spark, sf_dir, "documents").select("doc_id", structure.template_headers(marked).alias("text"))


def chunk_documents(spark, sf_dir):
    made = structure.chunks(structure.with_hierarchy(_layout(spark, sf_dir), structure.heading_rules(TOC)))
    return made.withColumn("pages", F.array_join("pages", ","))


def _totals(chunks, size: str):
    """What the chunks of a document hold together: words in order, and that none is over the limit."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda c: c["content"]), " ")
    found = chunks.groupBy("doc_id").agg(F.bool_and(F.col(size) <= structure.MAX_WORDS).alias("bounded"), one.alias("text"))
    return found.select("doc_id", "bounded", F.sha2(T.strip(F.regexp_replace("text", r"(?U)\s+", " ")), 256).alias("words_sha256"))


def chunk_totals(spark, sf_dir):
    return _totals(chunk_documents(spark, sf_dir), "n_words")


def chunk_token_totals(spark, sf_dir):
    """The same of chunks by tokens: the longest pieces of a public vocabulary, whatever follows a piece in a word."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = Vocabulary({p.removesuffix("</w>") for p in json.load(f)["model"]["vocab"]})
    return _totals(structure.chunks(structure.with_hierarchy(_layout(spark, sf_dir), structure.heading_rules(TOC)), vocabulary=vocabulary), "n_tokens")


QUERIES = {
    f.__name__: f
    for f in (
        html_clean, pii_detect, pii_mask, pii_restore, names_by_document, toc_page_ranges, page_methods, chunk_previews, synopsis_removed, footnotes_removed, hierarchy_fixed, hierarchy_by_document, template_headers, chunk_documents, chunk_totals, chunk_token_totals,
    )
}


def _html_sql() -> str:
    out = "html"
    for p in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    for entity, char in T.ENTITIES:
        quoted = "''''" if char == "'" else f"'{char}'"
        out = f"replace({out}, '{entity}', {quoted})"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_DETECT = " union all ".join(
    f"select doc_id, '{label}' as label, value, instr(text, value) as pos from (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{dict(privacy.PATTERNS)[label]}'))) as value from documents)"
    for label in dict(privacy.PATTERNS)
)

#: Values of a text are numbered by label in order of place and replaced one after the other, the longest first.
_MASK_SQL = f"""with e as (select doc_id, label, value, min(pos) as pos from ({_DETECT}) group by all),
f as (select doc_id, value, arg_min(label, (pos, label)) as label, min(pos) as pos from e group by doc_id, value),
n as (select *, '[' || label || '_' || row_number() over (partition by doc_id, label order by pos, value) || ']' as placeholder, row_number() over (partition by doc_id order by pos, label, value) as i from f),
l as (select doc_id, list(value || chr(1) || placeholder order by -length(value), i) as pairs from n group by doc_id)
select d.doc_id, case when l.pairs is null then d.text else list_reduce(list_prepend(d.text, l.pairs), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) end as masked,
  case when d.text is not null then cast(coalesce(len(l.pairs), 0) as bigint) end as n_pairs from documents d left join l using (doc_id)"""

_LAYOUT_SQL = """t as (select doc_id, 'Synopsis' || chr(10) || '| ' || string_split(text, chr(10))[1] || ' |' || chr(10) || '|---|' || chr(10) || 'entry one' || chr(10) || text || chr(10)
  || '5 [1 . Definition - body @@PAGE_1@@' || chr(10) || '12. A v B, AIR 1950 @@PAGE_2@@' || chr(10) || '12' || chr(10) || 'end' as text from documents where text is not null),
l as (select doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t))"""

_SYNOPSIS_SQL = f"""with recursive {_LAYOUT_SQL},
p as (select *, regexp_matches(s, '(?i)^[\\s|]*synopsis\\b') as begins, s = '' or regexp_matches(s, '^[\\s|\\-]+$') as bare, contains(s, '|') as piped,
  string_split(regexp_replace(s, '^\\|+|\\|+$', '', 'g'), '|') as c, regexp_replace(regexp_replace(lower(s), '@@page_\\d+@@', '', 'g'), '[^a-z0-9]', '', 'g') as body from l),
q as (select doc_id, i, begins, bare, piped, body, regexp_replace(lower(c[1] || coalesce(c[2], '')), '[^a-z0-9]', '', 'g') as named from p),
r as (select doc_id, 0::bigint as i, false as inside, '' as target, false as keep from t
  union all
  select q.doc_id, q.i::bigint, case when begins then true when not inside then false when target = '' then true else not closes end,
    case when begins or not inside then '' when target = '' then (case when bare then '' else named end) when closes then '' else target end, not begins and (not inside or (target <> '' and closes))
  from (select q.*, r.inside, r.target, body <> '' and not piped and (starts_with(body, r.target) or (length(body) > 5 and starts_with(r.target, body))) as closes from r join q on q.doc_id = r.doc_id and q.i = r.i + 1) q)
select r.doc_id, coalesce(string_agg(line, chr(10) order by r.i) filter (where keep), '') as text from r join l on l.doc_id = r.doc_id and l.i = r.i group by r.doc_id"""


def _hierarchy_sql() -> str:
    rules = structure.heading_rules(TOC)
    case = lambda value: "case " + " ".join(f"when regexp_matches(s, '(?i){r['pattern']}') then {value(r)}" for r in rules) + " end"
    text = lambda v: "null" if v is None else f"'{v}'"
    above = lambda r, i: r["above"][i] if len(r["above"]) > i else None
    return f"""with {_LAYOUT_SQL},
m as (select *, case when s <> '' then {case(lambda r: r['level'])} end as level, {case(lambda r: text(r['title']))} as raw, {case(lambda r: text(above(r, 0)))} as one, {case(lambda r: text(above(r, 1)))} as two,
  regexp_replace(regexp_replace({case(lambda r: f"regexp_extract(s, '(?i){r['pattern']}', 1)")}, '^[ .:;,\\-—–_=|*~\\t\\n\\r]+', ''), '^\\s+|\\s+$', '', 'g') as body from l),
n as (select *, case when level = 1 then raw when level in (2, 3) then nullif(one, '') end as need1, case when level = 2 then raw when level = 3 then nullif(two, '') end as need2 from m),
w as (select *, need1 is not null and level <> 1 and row_number() over (partition by doc_id, need1 order by i) = 1 as add1, need2 is not null and level = 3 and row_number() over (partition by doc_id, need2 order by i) = 1 as add2 from n),
o as (select doc_id, i, case when s = '' then '' when level is null and length(s) < 4 and regexp_matches(s, '^\\d+$') then null when level is null then line
  else (case when add1 then '# @@H1@@ ' || need1 || chr(10) else '' end) || (case when add2 then '## @@H2@@ ' || need2 || chr(10) else '' end) || repeat('#', level) || ' @@H' || level || '@@ ' || raw || (case when body <> '' then chr(10) || body else '' end) end as x from w)
select doc_id, string_agg(x, chr(10) order by i) as text from o group by doc_id"""


_BY_DOCUMENT_SQL = f"""with d as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]{{4,}}') as w from documents where text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
t as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s from l),
r as (select doc_id, level, w[level] as raw, case when level in (2, 3) then w[1] end as one, case when level = 3 then w[2] end as two, '(?i){structure.BEFORE_HEADING}' || w[level] || '{structure.AFTER_HEADING}' as pattern from d, range(1, 5) as x(level) where w[level] is not null),
f as (select t.doc_id, t.i, arg_min(struct_pack(level := r.level, raw := raw, one := one, two := two, body := regexp_extract(s, pattern, 1)), r.level) as x from t join r on r.doc_id = t.doc_id where s <> '' and regexp_matches(s, pattern) group by t.doc_id, t.i),
n as (select t.*, x.level as level, x.raw as raw, case when x.level = 1 then x.raw else x.one end as need1, case when x.level = 2 then x.raw else x.two end as need2, regexp_replace(regexp_replace(x.body, '^[ .:;,\\-—–_=|*~\\t\\n\\r]+', ''), '^\\s+|\\s+$', '', 'g') as body from t left join f using (doc_id, i)),
w as (select *, need1 is not null and level <> 1 and row_number() over (partition by doc_id, need1 order by i) = 1 as add1, need2 is not null and level = 3 and row_number() over (partition by doc_id, need2 order by i) = 1 as add2 from n),
o as (select doc_id, i, case when s = '' then '' when level is null and length(s) < 4 and regexp_matches(s, '^\\d+$') then null when level is null then line
  else (case when add1 then '# @@H1@@ ' || need1 || chr(10) else '' end) || (case when add2 then '## @@H2@@ ' || need2 || chr(10) else '' end) || repeat('#', level) || ' @@H' || level || '@@ ' || raw || (case when body <> '' then chr(10) || body else '' end) end as x from w)
select doc_id, coalesce(string_agg(x, chr(10) order by i), '') as text from o group by doc_id"""

#: A line with one page tag needs no look-ahead, and no line has two here.
_FOOTNOTE_SQL = structure.FOOTNOTE.replace("(?:(?!@@PAGE).)*?", ".*?")

_TOTALS_SQL = f"""with h as ({_hierarchy_sql()}),
b as (select doc_id, i, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from h) where not regexp_matches(line, '^#{{1,6}}\\s'))
select doc_id, true as bounded, sha256(trim(regexp_replace(regexp_replace(string_agg(line, ' ' order by i), '\\s*@@(?:PAGE_|H)\\d+@@\\s*', ' ', 'g'), '\\s+', ' ', 'g'))) as words_sha256 from b group by doc_id"""

#: Words of a text with their places, candidates by the first word of a name, the longest at a place, then a fold that drops what begins inside the one before.
_NAMES_SQL = """with m as (select distinct doc_id, unnest(regexp_extract_all(text, '([\\pL]+)\\.[0-9]+@', 1)) as name from documents),
a as (select name, 'PERSON' as label, count(*) / (count(*) + 1.0) as score from m group by name
  union all select array_to_string(string_split(text, ' ')[1:3], ' '), 'COMPANY', 0.9 from benchmark where len(string_split(text, ' ')) >= 3),
k as (select name, first(label order by score desc, label) as label, regexp_extract(name, '^[\\pL\\pN]*') as key from a where score >= 0.6 and name <> '' group by name),
t as (select doc_id, text, regexp_extract_all(text, '[\\pL\\pN]+|[^\\pL\\pN]+') as parts from documents),
p as (select doc_id, text, unnest(parts) as part, generate_subscripts(parts, 1) as i from t),
w as (select doc_id, text, part, 1 + coalesce(sum(length(part)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from p),
c as (select doc_id, pos, label, length(name) as n from w join k on part = key where substr(text, pos, length(name)) = name and not regexp_matches(substr(text, pos + length(name), 1), '[\\pL\\pN]')),
l as (select doc_id, pos, arg_max(label, n) as label, max(n) as n from c group by doc_id, pos),
g as (select doc_id, list([{'pos': pos, 'n': n, 'label': label}] order by pos) as hits from l group by doc_id),
f as (select doc_id, list_reduce(hits, lambda kept, h: case when h[1].pos >= kept[-1].pos + kept[-1].n then list_concat(kept, h) else kept end) as hits from g)
select d.doc_id, coalesce(len(list_filter(hits, lambda h: h.label = 'PERSON')), 0)::bigint as n_persons, coalesce(len(list_filter(hits, lambda h: h.label = 'COMPANY')), 0)::bigint as n_companies,
  coalesce(list_sum(list_transform(hits, lambda h: h.n)), 0)::bigint as n_chars, coalesce(list_sum(list_transform(hits, lambda h: h.pos)), 0)::bigint as places from documents d left join f using (doc_id)"""


ORACLE_SQL = {
    "names_by_document": _NAMES_SQL,
    "pii_mask": _MASK_SQL,
    "footnotes_removed": f"with {_LAYOUT_SQL} select doc_id, regexp_replace(regexp_replace(text, '(?i){_FOOTNOTE_SQL}', '', 'g'), '^\\s+|\\s+$', '', 'g') as text from t",
    "chunk_totals": _TOTALS_SQL,
    "chunk_token_totals": _TOTALS_SQL,
    "html_clean": f"select page_id, {_html_sql()} as text from pages",
    "pii_detect": f"select doc_id, label, value, cast(pos as bigint) as pos from ({_DETECT})",
    "pii_restore": "select doc_id, text as restored from documents",
    "toc_page_ranges": """with l as (select doc_id, n_chars, unnest(string_split(text, chr(10))) as title, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents where text is not null),
m as (select doc_id, n_chars, ord, case when ord % 3 = 1 then 2 else 1 end as level, coalesce(sum(length(title) + 1) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) // 400 + 1 as start_page from l),
r as (select *, coalesce(lead(start_page) over (partition by doc_id order by ord) - 1, n_chars // 400 + 1) as end_page from m)
select doc_id as doc, cast(ord as bigint) as ord, cast(start_page as bigint) as start_page, cast(end_page as bigint) as end_page from r where level = 1""",
    "page_methods": f"select page_id, case when length({_html_sql()}) > 50 then 'digital' else 'ocr' end as method from pages",
    "chunk_previews": "select doc_id, left(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 150) as preview from documents",
    "synopsis_removed": _SYNOPSIS_SQL,
    "hierarchy_fixed": _hierarchy_sql(),
    "hierarchy_by_document": _BY_DOCUMENT_SQL,
    "template_headers": """with l as (select doc_id, unnest(string_split(regexp_replace(text, '(?m)^The', '## The', 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '(?m)^The', '## The', 'g'), chr(10)), 1) as i from documents),
h as (select *, starts_with(line, '##') as head, sum(starts_with(line, '##')::int) over (partition by doc_id order by i) as n, trim(substr(line, 3), ' ' || chr(9) || chr(13)) as title from l)
select doc_id, string_agg(case when not head then line when n = 1 then '## ' || title || chr(10) || title else title end, chr(10) order by i) as text from h group by doc_id""",
}
