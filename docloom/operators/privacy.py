"""Personal data: detection by patterns and a name list, masking with numbered placeholders, restoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels and what recognises them offline; names of persons and companies come from a list or a model.
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("TAX ID", r"\b\d{2}-\d{7}\b"),
    ("DOCUMENT DATE", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("ROUTING NUMBER", r"\b\d{9}\b"),
    ("STREET ADDRESS", r"\b\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Lane)\b"),
    ("DIGITAL SIGNATURE", r"/s/ [A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)*"),
)
ENTITY = "struct<pos:int,label:string,value:string>"


def detect(text: Column, names: dict[str, list[str]] | None = None, recognise: Callable[[Column], Column] | None = None) -> Column:
    """Array of (pos, label, value) in order of position; pos counts characters from 1, of each value's first occurrence.

    names: listed values for labels without a pattern (persons, companies).
    recognise: a model's function from the text to an array of (label, value).
    """
    found = [F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))), _entity(text, label)) for label, p in PATTERNS]
    for label, values in (names or {}).items():
        listed = F.array(*[F.lit(v) for v in values])
        found.append(F.transform(F.filter(listed, lambda v: F.contains(text, v)), _entity(text, label)))
    if recognise is not None:
        found.append(F.transform(recognise(text), lambda e: F.struct(F.instr(text, e["value"]).alias("pos"), e["label"].alias("label"), e["value"].alias("value"))))
    return F.array_sort(F.flatten(F.array(*found)))


def _entity(text: Column, label: str):
    return lambda value: F.struct(F.instr(text, value).alias("pos"), F.lit(label).alias("label"), value.alias("value"))


def mapping(entities: Column) -> Column:
    """Array of (placeholder, value) in order of first occurrence: values of a label are numbered in that order.

    A value found under two labels keeps the first one's.
    """
    kind = "struct<seen:array<string>,counts:map<string,int>,out:array<struct<placeholder:string,value:string>>>"
    start = F.expr(f"cast(named_struct('seen', array(), 'counts', map(), 'out', array()) as {kind})")

    def step(acc: Column, e: Column) -> Column:
        n = F.coalesce(F.try_element_at(acc["counts"], e["label"]), F.lit(0)) + 1
        others = F.map_filter(acc["counts"], lambda k, _: k != e["label"])
        made = F.struct(F.concat(F.lit("["), e["label"], F.lit("_"), n.cast("string"), F.lit("]")).alias("placeholder"), e["value"].alias("value"))
        new = F.struct(
            F.concat(acc["seen"], F.array(e["value"])).alias("seen"), F.map_concat(others, F.create_map(e["label"], n)).alias("counts"), F.concat(acc["out"], F.array(made)).alias("out")
        ).cast(kind)
        return F.when(F.array_contains(acc["seen"], e["value"]), acc).otherwise(new)

    return F.aggregate(entities, start, step, lambda acc: acc["out"])


def mask(text: Column, pairs: Column) -> Column:
    """Values replaced by placeholders, the longest first (equal lengths in order of occurrence), one after the other."""
    placed = F.transform(pairs, lambda p, i: F.struct((-F.length(p["value"])).alias("n"), i.alias("i"), p.alias("p")))
    return F.aggregate(F.array_sort(placed), text, lambda acc, x: F.replace(acc, x["p"]["value"], x["p"]["placeholder"]))


def restore(text: Column, pairs: Column) -> Column:
    """Placeholders replaced by values, in the mapping's order."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["placeholder"], p["value"]))


def mask_documents(docs: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, masked, pairs, restored."""
    pairs = mapping(detect(F.col("text"), names))
    with_pairs = docs.select("doc_id", "text", pairs.alias("pairs"))
    masked = with_pairs.withColumn("masked", mask(F.col("text"), F.col("pairs")))
    return masked.select("doc_id", "masked", "pairs", restore(F.col("masked"), F.col("pairs")).alias("restored"))


def number_entities(entities: DataFrame) -> DataFrame:
    """The mapping of entity rows (doc_id, pos, label, value), for entities that come as a table."""
    first = Window.partitionBy("doc_id", "value").orderBy("pos", "label")
    once = entities.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    n = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("pos", "value"))
    return once.select("doc_id", "pos", "label", "value", F.concat(F.lit("["), F.upper("label"), F.lit("_"), n.cast("string"), F.lit("]")).alias("placeholder"))
