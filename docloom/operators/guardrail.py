"""Query gate: keyword rules as the offline default, and the parser of a gate model's answer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T


@dataclass(frozen=True)
class Topics:
    """What a gate goes by: words that always pass, and words that fail a query without one of them."""

    allowed: tuple[str, ...] = ("contract", "lawsuit", "court order", "lease", "bail", "cheque bounce")
    refused: tuple[str, ...] = ("recipe", "lottery", "joke", "weather")


def _names_one(query: Column, topics: tuple[str, ...]) -> Column:
    escaped = "|".join(re.escape(t) for t in topics)
    return F.lower(query).rlike(rf"(^|[^a-z0-9])({escaped})s?([^a-z0-9]|$)") if topics else F.lit(False)


def keyword_gate(query: Column, topics: Topics = Topics()) -> Column:
    """pass or fail; in doubt (and without a query) pass."""
    return F.when(_names_one(query, topics.allowed), "pass").when(_names_one(query, topics.refused), "fail").otherwise("pass")


def parse(raw: Column) -> Column:
    """struct<gate, response, reasoning> of a model's answer; a missing tag is null, the gate's tag is case-insensitive."""
    pattern = r"(?i)<gate>\s*(pass|fail)\s*</gate>"
    gate = F.when(raw.rlike(pattern), F.lower(F.regexp_extract(raw, pattern, 1)))
    return F.struct(gate.alias("gate"), T.tag_or_null(raw, "response").alias("response"), T.tag_or_null(raw, "reasoning").alias("reasoning"))


def blocks(gate: Column) -> Column:
    """Only an explicit fail blocks."""
    return F.coalesce(gate == "fail", F.lit(False))
