"""Application tables: users, knowledge bases, documents, chats, audit, uploads.  Tables are append-only; the latest row wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

NO_HISTORY = "No prior conversation history."
MAX_UPLOAD = 2 * 1024 * 1024


def latest(log: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    """The newest row's columns for each key of an append-only log."""
    return log.groupBy(key).agg(*[F.max_by(c, ts).alias(c) for c in columns])


def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n messages of each session, oldest first by ``turn``."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def history(messages: DataFrame, n: int = 5) -> DataFrame:
    """conv_id, history: ``Role: text`` of the last n messages, a blank line between."""
    line = F.concat(T.capitalised(F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = last_messages(messages, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    joined = T.strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"))
    return rows.select("conv_id", F.when(joined == "", NO_HISTORY).otherwise(joined).alias("history"))


def with_owner(rows: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """Only rows whose key one of ``owners`` has."""
    return rows.join(owners.select(F.col(owner).alias(key)), key, "left_semi")


def find_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``existing`` and the wanted rows whose key it lacks."""
    return existing.unionByName(wanted.join(existing, key, "left_anti"))


def rejected_signups(signups: DataFrame, users: DataFrame) -> DataFrame:
    """``signups`` (name, email, password) with the reasons against them."""
    taken = users.select("email").distinct().withColumn("taken", F.lit(True))
    checks = F.array(
        F.when(F.length("password") < 6, "password is too short"),
        F.when(F.length("name") < 3, "name is too short"),
        F.when(~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email is malformed"),
        F.when(F.col("taken"), "email is taken"),
    )
    return signups.join(taken, "email", "left").withColumn("reasons", F.filter(checks, lambda r: r.isNotNull())).drop("taken")


def upload_verdict(name: Column, size: Column, head: Column) -> Column:
    """struct<code, reason>: the first rule that an upload breaks; code 0 for none.  head: its first bytes as text."""
    suffixes = T.file_suffixes(name)
    verdict = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    return (
        F.when(size > MAX_UPLOAD, verdict(413, "too large"))
        .when(F.size(suffixes) > 1, verdict(400, "double extension"))
        .when((F.size(suffixes) == 0) | (F.lower(F.get(suffixes, F.lit(0))) != ".pdf"), verdict(400, "not a .pdf name"))
        .when(~F.coalesce(head.startswith("%PDF-"), F.lit(False)), verdict(400, "not a PDF"))
        .otherwise(verdict(0, "accepted"))
    )


def audit(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant's next answer and its share of the two texts."""
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.withColumns({"next_role": F.lead("role").over(nxt), "response": F.lead("text").over(nxt)})
    return paired.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), "response")


NEW_SESSION = "New Conversation"


def session_titles(created: DataFrame, messages: DataFrame, title=lambda query: F.array_join(F.slice(F.split(T.clean_title(query), r"\s+"), 1, 5), " ")) -> DataFrame:
    """conv_id, title: the newest row of a log of titles, which begins with NEW_SESSION and gets one from the first user message.

    title: a model's function; by default the first five words.
    """
    first = messages.where("role = 'user' and text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    log = created.select("conv_id", F.lit(0).alias("at"), F.lit(NEW_SESSION).alias("title")).unionByName(first.select("conv_id", F.lit(1).alias("at"), title(F.col("query")).alias("title")))
    return latest(log, "conv_id", "at", "title").join(created.select("conv_id"), "conv_id", "left_semi")


def logged_messages(messages: DataFrame, blocked: Column, n_history: int = 5) -> DataFrame:
    """conv_id, turn, role, tokens of the messages that are logged.

    A user message counts its own words and those of the last messages before it;
    a message that the gate blocks is not logged, the assistant's refusal is.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n_history, -1)
    n = F.size(T.words(F.col("text")))
    counted = messages.select("conv_id", "turn", "role", "text", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("history"))
    tokens = F.col("n") + F.when(F.col("role") == "user", F.col("history")).otherwise(F.lit(0))
    return counted.where(~((F.col("role") == "user") & F.coalesce(blocked, F.lit(False)))).select("conv_id", "turn", "role", tokens.cast("long").alias("tokens"))


def default_kb(kb: Column, doc: Column, internal: str = "internal") -> Column:
    """struct<kb, doc>: the internal knowledge base where neither is given."""
    given = lambda c: F.nullif(c, F.lit(""))
    neither = given(kb).isNull() & given(doc).isNull()
    return F.struct(F.when(neither, F.lit(internal)).otherwise(kb).alias("kb"), F.when(~neither, doc).alias("doc"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows as a response shows them: ids and other whole numbers of type long as text, timestamps in ISO 8601, nulls kept."""
    as_shown = {"bigint": lambda c: c.cast("string"), "timestamp": iso, "timestamp_ntz": iso}
    return rows.select(*[as_shown.get(kind, lambda c: c)(F.col(f"`{name}`")).alias(name) for name, kind in rows.dtypes])


def wrapped_toc(raw: Column) -> Column:
    """A model's table of contents as JSON text of a list: an object becomes a list of one, but for the object that says there is none."""
    bare = T.strip(T.without_fences(raw))
    one = bare.startswith("{")
    return F.when(one & F.get_json_object(bare, "$.error").isNotNull(), bare).when(one, F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)


def toc_of(text: Column, ask) -> Column:
    """The table of contents that a model (a function from text to its answer) finds."""
    return wrapped_toc(ask(text))


# --- metadata and prompts ----------------------------------------------------

#: Metadata that stays inside.
HIDDEN_KEYS = ("rerank_score", "score", "collection_name", "vector_id")


def sanitised(metadata: Column) -> Column:
    """A map of arrays of strings as a map of strings: null and empty entries dropped, lists joined by a comma."""
    kept = F.map_filter(metadata, lambda _, v: v.isNotNull() & (F.size(v) > 0))
    return F.transform_values(kept, lambda _, v: F.array_join(v, ", "))


def formatted_chunk(number: Column, entries: Column, content: Column) -> Column:
    """A chunk for the prompt.  entries: array of (key, value) in order; hidden keys and nulls are left out."""
    shown = F.filter(entries, lambda e: ~e["key"].isin(*HIDDEN_KEYS) & e["value"].isNotNull())
    lines = F.transform(shown, lambda e: F.concat(F.lit("    "), T.title_from_key(e["key"]), F.lit(": "), e["value"]))
    return F.concat(
        F.lit('<chunk id="'), number.cast("string"), F.lit('">\n      <source_metadata>\n    '), F.array_join(lines, "\n"),
        F.lit("\n      </source_metadata>\n      <content>\n        "), T.strip(content), F.lit("\n      </content>\n    </chunk>"),
    )


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a markdown table, a rule below the first row."""
    cell = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r))))), "\n")


EXTRACTION = (
    "struct<document_metadata:struct<inferred_title:string,document_category:string,governing_law_jurisdiction:string,executive_summary:string>,"
    "parties_involved:array<struct<entity_name:string,legal_role:string,entity_type:string>>,critical_dates:array<struct<event_description:string,normalized_date:date>>,"
    "financial_details:array<struct<category:string,amount:double,currency:string>>,extracted_clauses:array<struct<clause_theme:string,brief_summary:string>>,"
    "risk_and_compliance:struct<is_signed:boolean,unusual_or_high_risk_terms:array<string>>>"
)


def extraction(raw: Column) -> Column:
    """A structured record from a model's answer; null where it is not JSON."""
    return F.from_json(T.without_fences(raw), EXTRACTION)
