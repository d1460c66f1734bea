"""Names of persons and companies from a table: all names are looked for in one pass over each text.

A name stands where its characters stand with neither a letter nor a digit right before
or after them.  Of names that overlap, the one that begins first counts, and of those
that begin at one place the longest; the search goes on behind it.

A table of up to ``most_bytes`` (counted before) goes to every task as an automaton of all its names.
A larger one is met by a join: each task cuts out the strings that a name could be,
by the first words of names and the lengths that names with such a first word have,
and those strings are joined to the names.  First words of more than ``most_keys`` are
not sent; then every place where a word could begin gives strings of all lengths.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from docloom.functions.ship import map_batches
from docloom.operators import privacy

#: Least score of a name.
THRESHOLD = 0.6
MOST_BYTES, MOST_KEYS = 64 << 20, 1 << 20
FOUND = StructType([StructField("pos", IntegerType()), StructField("label", StringType()), StructField("value", StringType()), StructField("score", DoubleType())])
_FOUND = pa.list_(pa.struct([("pos", pa.int32()), ("label", pa.string()), ("value", pa.string()), ("score", pa.float64())]))
_RUN = re.compile(r"[^\W_]+")


def known(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """name, label, score of names (name, label, score) that reach the threshold, each once: the highest score, then the first label."""
    good = names.where("name <> ''").where(F.col("score") >= threshold)
    best = F.struct((-F.col("score")).alias("s"), "label")
    return good.groupBy("name").agg(F.min(best).alias("b")).select("name", "b.label", (-F.col("b.s")).cast("double").alias("score"))


def leftmost_longest(spans: list[tuple]) -> list[tuple]:
    """Of (begin, end, ...) those that stay when overlaps are resolved, in order."""
    out, behind = [], 0
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if span[0] >= behind:
            out.append(span)
            behind = span[1]
    return out


def _apart(text: str, begin: int, end: int) -> bool:
    return not (begin and text[begin - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


class Automaton:
    """All names at once; built by each worker when it first reads a text."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.rows, self.machine = rows, None

    def __getstate__(self):
        return {"rows": self.rows, "machine": None}

    def found(self, text: str) -> list[tuple]:
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for name, label, score in self.rows:
                self.machine.add_word(name, (name, label, score))
            self.machine.make_automaton()
        spans = ((last + 1 - len(row[0]), last + 1, row) for last, row in self.machine.iter(text)) if self.rows else ()
        return leftmost_longest([s for s in spans if _apart(text, s[0], s[1])])


def _entities(spans: list[tuple], once: bool) -> list[dict]:
    seen: set[str] = set()
    out = []
    for begin, _, (value, label, score) in spans:
        if not (once and value in seen):
            out.append({"pos": begin + 1, "label": label, "value": value, "score": score})
            seen.add(value)
    return out


def _strings(text: str, lengths: dict[str | None, list[int]]):
    """(begin, string) of all that could be a name; lengths: those of names by their first word, or of all under None."""
    everywhere = lengths.get(None)
    runs = {m.start(): m[0] for m in _RUN.finditer(text)}
    begins = runs if everywhere is None and "" not in lengths else range(len(text))
    for begin in begins:
        if begin and text[begin - 1].isalnum():
            continue
        for n in lengths.get(runs.get(begin, ""), ()) if everywhere is None else everywhere:
            if begin + n <= len(text) and _apart(text, begin, begin + n):
                yield begin, text[begin : begin + n]


def _by_automaton(docs: DataFrame, rows: list[tuple], once: bool) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(Automaton(rows))  # of most_bytes at most, counted before
    out = StructType([*docs.schema.fields, StructField("found", ArrayType(FOUND))])
    at = docs.columns.index("text")

    def run(batches):
        own = given.value
        for batch in batches:
            made = [_entities(own.found(t), once) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _FOUND)], names=out.fieldNames())

    return map_batches(docs, run, out)


def _lengths(names: DataFrame, most_keys: int) -> dict[str | None, list[int]]:
    """Lengths of names by first word, if there are few first words, else all lengths under None."""
    first = F.regexp_extract("name", r"^([\p{L}\p{N}]*)", 1)
    pairs = names.select(first.alias("key"), F.length("name").alias("n")).distinct()
    rows = pairs.groupBy("key").agg(F.collect_list("n").alias("n")).limit(most_keys + 1).collect()
    if len(rows) <= most_keys:
        return {r.key: r.n for r in rows}
    return {None: [r.n for r in pairs.select("n").distinct().collect()]}  # as many as the longest name has characters


def _by_join(docs: DataFrame, names: DataFrame, once: bool, most_keys: int) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(_lengths(names, most_keys))
    digest = F.sha2("text", 256)  # copies of a text are searched once
    texts = docs.where("text is not null").groupBy(digest.alias("digest")).agg(F.first("text").alias("text"))
    cut = StructType([StructField("digest", StringType()), StructField("pos", IntegerType()), StructField("name", StringType())])

    def strings(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                places = list(_strings(text.as_py(), given.value))
                columns = [pa.array([key] * len(places), pa.string()), pa.array([p for p, _ in places], pa.int32()), pa.array([s for _, s in places], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=cut.fieldNames())

    resolved = StructType([StructField("digest", StringType()), StructField("found", ArrayType(FOUND))])

    def resolve(batches):
        for batch in batches:
            made = [_entities(leftmost_longest([(h["pos"], h["pos"] + len(h["name"]), (h["name"], h["label"], h["score"])) for h in hits]), once) for hits in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, _FOUND)], names=resolved.fieldNames())

    hits = map_batches(texts, strings, cut).join(names, "name")
    hits = hits.groupBy("digest").agg(F.collect_list(F.struct("pos", "name", "label", "score")).alias("hits"))  # names found in one text
    found = map_batches(hits, resolve, resolved).withColumnRenamed("digest", "__digest")
    joined = docs.withColumn("__digest", digest).join(found, "__digest", "left").drop("__digest")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(ArrayType(FOUND))))


def detect(docs: DataFrame, names: DataFrame, threshold: float = THRESHOLD, once: bool = False, most_bytes: int = MOST_BYTES, most_keys: int = MOST_KEYS) -> DataFrame:
    """``docs`` with ``found``: array of (pos, label, value, score) of the names in ``text``, in order; pos counts characters from 1.

    names: name, label, score.  once: only each name's first place.  A null or empty
    text, and an empty table of names, give empty arrays; repeated rows are rows of their own.
    """
    docs, names = docs.drop("found"), known(names, threshold).persist()  # read for its size, then for its rows
    size = names.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("label") + 16), F.lit(0)).alias("n")).first().n
    if size <= most_bytes:
        rows = [tuple(r) for r in names.collect()]
        names.unpersist()
        return _by_automaton(docs, rows, once)
    return _by_join(docs, names, once, most_keys)


def mask_documents(docs: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, masked, pairs, restored: as ``privacy.mask_documents``, with names from a table."""
    text = F.col("text")
    plain: Column = F.transform("found", lambda e: F.struct(e["pos"].alias("pos"), e["label"].alias("label"), e["value"].alias("value")))
    found = detect(docs.select("doc_id", "text"), names, threshold, once=True)
    pairs = privacy.mapping(F.array_sort(F.concat(privacy.detect(text), plain)))
    masked = found.select("doc_id", "text", pairs.alias("pairs")).withColumn("masked", privacy.mask(text, F.col("pairs")))
    return masked.select("doc_id", "masked", "pairs", privacy.restore(F.col("masked"), F.col("pairs")).alias("restored"))
