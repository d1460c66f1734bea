"""Heading hierarchy where each document has a table of contents of its own: rules are a table, met by a join.

``structure.with_hierarchy`` has the rules of one document set as literals of its plan.
Here rules are rows (doc_id, ord, level, title, above), and a line meets only rules of
its document with which it shares a word, the rule's anchor; the pattern then
decides, and of the rules that match the first in order wins.

Anchors are runs of the letters a-z, without case.  In a line that matches, a run of
the title stands as it is, but for two places: letters of a Roman number may stand
right before the first run, and letters may follow the last run right away.  So the anchor is
the longest run that is not the last (or is, but something else ends the title); a
line gives each of its runs, also without Roman letters at its begin.  A title of a single
run is looked for among the begins of the line's runs, of the lengths that such
titles of the document have.  A title without letters meets every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.structure import _RUN_IN, AFTER_HEADING, BEFORE_HEADING

#: Characters beyond ASCII that a pattern without case takes for letters, and these.
FOLDED = ("ſKıİ", "skii")
#: So many anchors are looked for in each line one by one; of more, a line's keys are looked up.
FEW = 32
RULE = "array<struct<level:int,title:string,above:array<string>>>"


def rules_of(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, above: rules of tables of contents given in blocks.

    blocks: doc_id, ord, name, chapters, sections, subs (arrays).  A block's name is
    level 1; chapters stand below it, sections below it and its first chapter.
    """
    name = F.col("name")
    rows = lambda column, level, above: F.transform(F.coalesce(column, F.array()), lambda x: F.struct(F.lit(level).alias("level"), x.alias("title"), above.alias("above")))
    none = F.array().cast("array<string>")
    each = F.concat(rows(F.array(name), 1, none), rows(F.col("chapters"), 2, F.array(name)), rows(F.col("sections"), 3, F.array(name, F.get("chapters", F.lit(0)))), rows(F.col("subs"), 4, none)).cast(RULE)
    found = blocks.select("doc_id", "ord", F.posexplode(each).alias("at", "rule")).where("rule.title <> ''")
    return found.select("doc_id", F.struct("ord", "at").alias("ord"), "rule.level", "rule.title", "rule.above")


def pattern(title: Column) -> Column:
    """The pattern of ``structure.heading_pattern`` for a column of titles."""
    escaped = F.regexp_replace(T.strip(title), r"([\\^$|?*+()\[\]{}])", r"\\$1")
    for char, flexible in ((".", r"\s*\.\s*"), ("-", r"\s*[\-—–]\s*"), (" ", r"\s+")):
        escaped = F.replace(escaped, F.lit(char), F.lit(flexible))
    return F.concat(F.lit("(?iu)" + BEFORE_HEADING), escaped, F.lit(AFTER_HEADING))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(text, *FOLDED)), F.lit("([a-z]+)"), F.lit(1))


def _anchored(rules: DataFrame) -> DataFrame:
    """Rules with ``anchor`` and ``begins``: whether the anchor is looked for among begins."""
    title = T.strip(F.col("title"))
    open_end = F.translate(title, *FOLDED).rlike("[A-Za-z]$")
    runs = _runs(title)
    closed = F.when(open_end, F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(runs)
    longest = F.reduce(closed, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    single = open_end & (F.size(runs) == 1)
    return rules.withColumns({"begins": single, "anchor": F.when(single, F.get(runs, F.lit(0))).otherwise(longest)})


def _keys(line: Column, lengths: Column) -> Column:
    """What a line may be asked for: struct(begins, anchor)."""
    key = lambda begins, x: F.struct(F.lit(begins).alias("begins"), x.alias("anchor"))
    roman = lambda run: F.length(F.regexp_extract(run, "^([ivxlcdm]*)", 1))
    # a run, and what is left of it after each number of Roman letters
    tails = F.flatten(F.transform(_runs(line), lambda run: F.filter(F.transform(F.sequence(F.lit(0), roman(run)), lambda n: F.substr(run, n + 1)), lambda x: x != "")))
    begins = F.flatten(F.transform(tails, lambda run: F.transform(F.filter(lengths, lambda n: n <= F.length(run)), lambda n: F.substr(run, F.lit(1), n))))
    whole = F.array_union(F.array(F.lit("")), tails)
    return F.concat(F.transform(whole, lambda x: key(False, x)), F.transform(F.array_distinct(begins), lambda x: key(True, x)))


def matched_lines(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, above, body of the lines that a rule matches.

    A document's anchors come to its row, so that only keys which are anchors, with
    their lines, leave the task that reads the text.
    """
    known = _anchored(rules.select("doc_id", "ord", "level", "title", "above"))
    anchors = known.groupBy("doc_id").agg(F.collect_set(F.struct("begins", "anchor")).alias("anchors"))  # of one table of contents
    lines = docs.where("text is not null").select("doc_id", "text").join(anchors, "doc_id").select("doc_id", "anchors", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lengths = F.array_distinct(F.transform(F.filter("anchors", lambda a: a["begins"]), lambda a: F.length(a["anchor"])))
    lines = lines.select("doc_id", "line_no", "anchors", lengths.alias("lengths"), T.strip(F.col("line")).alias("s")).where("s <> ''")
    folded = F.lower(F.translate("s", *FOLDED))
    few = F.filter("anchors", lambda a: F.contains(folded, a["anchor"]))
    hits = F.when(F.size("anchors") <= FEW, few).otherwise(F.array_intersect(_keys(F.col("s"), F.col("lengths")), "anchors"))
    keyed = lines.select("doc_id", "line_no", "s", F.explode(hits).alias("key")).select("doc_id", "line_no", "s", "key.*")
    found = keyed.join(known.withColumn("pattern", pattern(F.col("title"))), ["doc_id", "begins", "anchor"]).where(F.expr("s rlike pattern"))
    body = T.strip(F.regexp_replace(F.expr("regexp_extract(s, pattern, 1)"), _RUN_IN, ""))
    return found.groupBy("doc_id", "line_no").agg(F.min_by(F.struct("level", "title", "above", body.alias("body")), F.struct("ord")).alias("rule")).select("doc_id", "line_no", "rule.*")


def with_hierarchy(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, text of ``docs`` (doc_id once each, text) with the marked headings of ``structure.with_hierarchy``.

    rules: doc_id, ord (anything with an order), level, title, above.  A document
    without rules loses its lone page numbers and is else unchanged, a null text
    stays null.
    """
    above = lambda depth: F.nullif(F.when(F.col("level") == depth, F.col("title")).otherwise(F.get("above", F.lit(depth - 1))), F.lit(""))
    heads = matched_lines(docs, rules).withColumns({"one": above(1), "two": above(2)})
    place = lambda name: F.row_number().over(Window.partitionBy("doc_id", name).orderBy("line_no")) == 1
    heads = heads.withColumns({"first_one": F.col("one").isNotNull() & place("one"), "first_two": F.col("two").isNotNull() & place("two")})
    mark = lambda level, text: F.concat(F.repeat(F.lit("#"), level), F.lit(" @@H"), level.cast("string"), F.lit("@@ "), text)
    headed = F.array(
        F.when((F.col("level") != 1) & F.col("first_one"), mark(F.lit(1), F.col("one"))),
        F.when((F.col("level") == 3) & F.col("first_two"), mark(F.lit(2), F.col("two"))),
        mark(F.col("level"), F.col("title")),
        F.when(F.col("body") != "", F.col("body")),
    )
    found = heads.select("doc_id", "line_no", F.array_compact(headed).alias("out")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "out"))).alias("heads"))  # headings of one document

    def written(line: Column, at: Column) -> Column:
        s = T.strip(line)
        page_number = (F.length(s) < 4) & s.rlike(r"^\d+$")
        plain = F.when(s == "", F.array(F.lit(""))).when(page_number, F.array().cast("array<string>")).otherwise(F.array(line))
        return F.coalesce(F.try_element_at("heads", at), plain)

    # a document's text is one row before and after, and is made anew in its row
    text = F.array_join(F.flatten(F.transform(F.split("text", "\n"), written)), "\n")
    return docs.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", text.alias("text"))
