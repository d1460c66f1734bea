"""Usage quotas: daily and monthly windows in UTC, in batch.

Two forms.  For requests of one unit (uploads) admission has a closed form with
window functions: refused requests use nothing and a full bucket stays full, so a
request is admitted when it is among the day's first and, of those, among the
month's first.  Reservations with later adjustments need the events in order:
``fold`` replays each user's events once, in order of time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docloom.functions import text as T
from docloom.functions.ship import map_batches


@dataclass(frozen=True)
class Limits:
    daily: int
    monthly: int


#: The free tier.
UPLOADS = Limits(2, 30)
CHAT_TOKENS = Limits(1_000, 20_000)
RESERVED_FOR_CHAT = 600


def admit_units(events: DataFrame, limits: Limits = UPLOADS) -> DataFrame:
    """``events`` (event_id, user_id, ts), one unit each, with admitted."""
    keyed = events.withColumns({"day": T.day_key(F.col("ts")), "month": T.month_key(F.col("ts"))})
    in_day = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) <= limits.daily
    ranked = keyed.withColumn("in_day", in_day)
    in_month = F.sum(F.col("in_day").cast("int")).over(Window.partitionBy("user_id", "month").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)) <= limits.monthly
    return ranked.withColumn("admitted", F.col("in_day") & in_month).drop("in_day")


def usage(events: DataFrame) -> DataFrame:
    """user_id, day, used: amounts by user and day."""
    return events.groupBy("user_id", T.day_key(F.col("ts")).alias("day")).agg(F.sum("amount").alias("used"))


DECISION = StructType(
    [StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("admitted", BooleanType()), StructField("day_used", LongType()), StructField("month_used", LongType())]
)


def fold(events: DataFrame, limits: Limits = CHAT_TOKENS) -> DataFrame:
    """user_id, event_id, admitted, day_used, month_used: what each event finds and leaves.

    events: event_id, user_id, ts, kind (reserve or adjust), amount.  A reservation
    that would pass a limit is refused and uses nothing; an adjustment always
    counts and may pass the limit or give back.  An optional column ``settle`` is
    what an admitted reservation turns out to be more or less (a chat that the gate
    refuses gives all of it back).  Events come to a task as a stream
    sorted by user and time, of which it holds one user's two buckets.
    """
    rows = events.select(
        F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), T.day_key(F.col("ts")).alias("day"), T.month_key(F.col("ts")).alias("month"),
        (F.col("kind") == "adjust").alias("adjust"), F.col("amount").cast("long").alias("amount"), (F.coalesce("settle", F.lit(0)) if "settle" in events.columns else F.lit(0)).cast("long").alias("settle"), "ts",
    )
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").drop("ts")

    def run(batches):
        user, day, month, day_used, month_used = None, "", "", 0, 0
        for b in batches:
            admitted, left_day, left_month = [], [], []
            for u, d, m, adjust, amount, settle in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                day_used, month_used = day_used if (u, d) == (user, day) else 0, month_used if (u, m) == (user, month) else 0
                user, day, month = u, d, m
                ok = adjust or (day_used + amount <= limits.daily and month_used + amount <= limits.monthly)
                if ok:
                    day_used, month_used = day_used + amount + settle, month_used + amount + settle
                admitted.append(ok)
                left_day.append(day_used)
                left_month.append(month_used)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(admitted, pa.bool_()), pa.array(left_day, pa.int64()), pa.array(left_month, pa.int64())], names=DECISION.fieldNames())

    return map_batches(rows, run, DECISION)


def left(used, limit: int):
    """What a status read shows."""
    return F.greatest(F.lit(0), F.lit(limit) - F.coalesce(used, F.lit(0)))
