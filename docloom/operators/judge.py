"""Judge verdicts to decisions, on arrays: no row is exploded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

FALLBACK_MESSAGE = "No sufficiently relevant passage was found in the knowledge base."

CHUNK = "struct<chunk_id:string,relevant:boolean,supports_answer:boolean,score:double,chunk_type_match:boolean,reason:string,missing_aspects:array<string>>"
VERDICT = f"struct<query:string,overall_decision:string,confidence:double,retry_reason:string,chunk_results:array<{CHUNK}>>"


@dataclass(frozen=True)
class Thresholds:
    pass_at: float = 0.78
    retry_at: float = 0.50
    min_relevant: int = 1
    require_supporting: bool = True
    require_type_match: bool = True

    def __post_init__(self):
        if not self.retry_at < self.pass_at:
            raise ValueError("the retry threshold must be below the pass threshold")


def parse(raw: Column) -> Column:
    """A verdict from JSON text; null where it is none."""
    return F.from_json(raw, VERDICT)


def rounded(score: Column) -> Column:
    """Four digits, of the number that a double holds: only an exact half, as 0.5 / 4096 is none, goes to the even digit.

    ``round`` and ``bround`` see the double's shortest decimal text, in which many
    numbers are halves that are none.  Here 20000 x is made exactly, as the sum
    of two products, and held against the odd number between the two candidates.
    """
    size = F.abs(score.cast("double"))
    split = size * F.lit(134217729.0)  # 2 ** 27 + 1: the upper half of the digits
    upper = split - (split - size)
    below = F.floor(size * 10000.0)
    over = (upper * 20000.0 - (2 * below + 1).cast("double")) + (size - upper) * 20000.0
    up = F.when(over != 0, (over > 0).cast("int")).otherwise((below % 2).cast("int"))
    # beyond this all digits after the point are zeros or the steps of doubles are wider than a digit
    return F.when(size < 1e9, F.signum(score.cast("double")) * (below + up).cast("double") / 10000.0).otherwise(score.cast("double"))


def valid_chunks(chunks: Column, t: Thresholds = Thresholds()) -> Column:
    return F.filter(chunks, lambda c: F.coalesce(c["relevant"] & (c["chunk_type_match"] if t.require_type_match else F.lit(True)), F.lit(False)))


def decide(confidence: Column, chunks: Column, t: Thresholds = Thresholds()) -> Column:
    """PASS, RETRY or FALLBACK; without chunks FALLBACK unless the confidence alone asks for a retry."""
    valid = valid_chunks(chunks, t)
    top = F.coalesce(F.array_max(F.transform(valid, lambda c: c["score"])), F.lit(0.0))
    supporting = F.size(F.filter(valid, lambda c: F.coalesce(c["supports_answer"], F.lit(False))))
    passed = (confidence >= t.pass_at) & (F.size(valid) >= t.min_relevant) & (top >= t.pass_at)
    if t.require_supporting:
        passed = passed & (supporting >= 1)
    return F.when(passed, "PASS").when((F.size(chunks) > 0) & ((confidence >= t.retry_at) | (top >= t.retry_at)), "RETRY").otherwise("FALLBACK")


def _best_first(chunks: Column) -> Column:
    """By falling score; equal scores keep their order."""
    placed = F.transform(chunks, lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(placed), lambda x: x["c"])


def final_chunks(chunks: Column, t: Thresholds = Thresholds()) -> Column:
    return _best_first(F.filter(valid_chunks(chunks, t), lambda c: c["supports_answer"] & (c["score"] >= t.pass_at)))


def retry_chunks(chunks: Column, t: Thresholds = Thresholds()) -> Column:
    return _best_first(F.filter(valid_chunks(chunks, t), lambda c: (c["score"] >= t.retry_at) & (c["score"] < t.pass_at)))


def evaluate(verdicts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``verdicts`` (confidence, chunk_results) with decision, final_chunks, retry_chunks and fallback_message."""
    c, chunks = F.col("confidence"), F.col("chunk_results")
    decision = decide(c, chunks, t)
    return verdicts.withColumns(
        {
            "decision": decision,
            "final_chunks": final_chunks(chunks, t),
            "retry_chunks": retry_chunks(chunks, t),
            "fallback_message": F.when(decision == "FALLBACK", F.lit(FALLBACK_MESSAGE)),
        }
    )


def violations(v: Column) -> Column:
    """Names of the rules that a verdict breaks."""
    chunk_bad = lambda name, test: F.when(F.exists(v["chunk_results"], test), F.lit(name))
    checks = [
        F.when(T.is_blank(v["query"]), "query is blank"),
        F.when(F.coalesce(F.size(v["chunk_results"]), F.lit(0)) < 1, "no chunk results"),
        F.when(~F.coalesce(v["confidence"].between(0, 1), F.lit(False)), "confidence outside 0 to 1"),
        F.when((v["overall_decision"] != "PASS") & T.is_blank(v["retry_reason"]), "retry reason is missing"),
        chunk_bad("chunk id is blank", lambda c: T.is_blank(c["chunk_id"])),
        chunk_bad("reason is blank", lambda c: T.is_blank(c["reason"])),
        chunk_bad("score outside 0 to 1", lambda c: ~F.coalesce(c["score"].between(0, 1), F.lit(False))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def collect_final(results: DataFrame, approved: DataFrame) -> DataFrame:
    """Rows of ``results`` whose (query_id, doc_id) the judge approved, in their own order."""
    return results.join(approved, ["query_id", "doc_id"], "left_semi")
