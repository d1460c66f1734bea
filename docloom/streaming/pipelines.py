"""Structured Streaming forms: ingestion of uploaded documents and quota admission."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from docloom.functions import text as T
from docloom.operators import quota, structure

MAX_ATTEMPTS = 3
TRIED = StructType([StructField("doc_id", LongType()), StructField("status", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType()), StructField("text", StringType())])


# The processors are made by functions and name nothing of this package, so that they are sent as code:
# neither the driver's nor the executors' state workers need an installation of it.


def _tries(parse: Callable, kind: DataType, most: int, delay_ms: int) -> StatefulProcessor:
    """Parses each document by itself; one that fails waits in the state, with its tries, for a timer of its own."""
    waiting = StructType([StructField("content", kind), StructField("attempts", IntegerType())])
    names = TRIED.fieldNames()

    class Tries(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", waiting)

        def attempt(self, doc, content, attempts: int, now: int):
            try:
                row = (doc, "completed", attempts, None, parse(content))
            except Exception as e:
                row = (doc, "retrying" if attempts < most else "failed", attempts, f"{type(e).__name__}: {e}"[:1000], None)
            if row[1] == "retrying":
                self.waiting.update((content, attempts))
                self.handle.registerTimer(now + delay_ms)
            else:
                self.waiting.clear()
            return pd.DataFrame([row], columns=names)

        def handleInputRows(self, key, rows, timerValues):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            content = list(pd.concat(list(rows))["content"])[-1]  # a document that came again begins anew
            yield self.attempt(key[0], content, 1, timerValues.getCurrentProcessingTimeInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.waiting.exists():
                content, attempts = self.waiting.get()
                yield self.attempt(key[0], content, attempts + 1, timerValues.getCurrentProcessingTimeInMs())

        def close(self) -> None:
            pass

    return Tries()


def parsed(documents: DataFrame, parse: Callable, tries: int = MAX_ATTEMPTS, delay: float = 60.0) -> DataFrame:
    """A stream of documents (doc_id, content) as one of tries: doc_id, status, attempts, error, text.

    status: completed (with the text), retrying (after ``delay`` seconds), or failed
    after ``tries``.  A bad document delays no other.  Tries outlive a restart, for
    they are state; timers need a trigger that goes on.
    """
    kind = documents.schema["content"].dataType
    return documents.select("doc_id", "content").groupBy("doc_id").transformWithStateInPandas(_tries(parse, kind, tries, int(1000 * delay)), TRIED, "Append", "ProcessingTime")


def ingest(
    spark: SparkSession, source: str, schema: str, chunk_sink: str, status_sink: str, checkpoint: str, parse: Callable = lambda text: text, build: Callable[[DataFrame], DataFrame] = structure.chunks,
    delay: float = 60.0, tries: int = MAX_ATTEMPTS, trigger: dict | None = None,
):
    """Starts a query that turns documents (doc_id, text) arriving as Parquet in ``source`` into chunks, with a status row for each try.

    parse: from what a document holds to its text; runs in the executors and may
    raise.  A batch is written under its own number, so that a batch that is run
    again replaces what it wrote.  trigger: all that is there and an end, if None;
    documents that wait for a try then wait for the next start.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()  # parsed once for both tables
        build(batch.where("status = 'completed'").select("doc_id", "text")).write.mode("overwrite").parquet(f"{chunk_sink}/batch={number}")
        batch.drop("text").withColumn("ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{status_sink}/batch={number}")
        batch.unpersist()

    arriving = spark.readStream.schema(schema).parquet(source).select("doc_id", F.col("text").alias("content"))
    return parsed(arriving, parse, tries, delay).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


ADMISSION = StructType(
    [StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("admitted", BooleanType()), StructField("day_used", LongType()), StructField("month_used", LongType())]
)
_NAME, _USED = StructType([StructField("bucket", StringType())]), StructType([StructField("used", LongType())])
#: Buckets of months this far before the newest one are dropped; an event later than that finds them empty.
KEPT_MONTHS = 2


def _quota(daily: int, monthly: int) -> StatefulProcessor:
    """Replays each user's reservations and adjustments in order of time; state is a bucket for each day and month.

    A late event counts in the day and month that it is of, and changes no later
    bucket but its month's.
    """
    names, bucket_name, bucket_used, months = ADMISSION.fieldNames(), _NAME, _USED, KEPT_MONTHS

    class Quota(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getMapState("buckets", bucket_name, bucket_used)

        def handleInputRows(self, key, rows, timerValues):
            events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            used: dict[str, int] = {}

            def of(bucket: str) -> int:
                if bucket not in used:
                    used[bucket] = self.state.getValue((bucket,))[0] if self.state.containsKey((bucket,)) else 0
                return used[bucket]

            out = []
            for event, day, month, kind, amount in zip(*(events[c] for c in ("event_id", "day", "month", "kind", "amount"))):
                admitted = kind == "adjust" or (of(day) + amount <= daily and of(month) + amount <= monthly)
                for bucket in (day, month):
                    used[bucket] = of(bucket) + (int(amount) if admitted else 0)
                out.append((event, key[0], bool(admitted), used[day], used[month]))
            for bucket, n in used.items():
                self.state.updateValue((bucket,), (n,))
            known = [name for (name,) in self.state.keys()]
            year, month = map(int, max(known)[:7].split("-"))
            oldest = 12 * year + month - 1 - months
            for name in known:
                if name < f"{oldest // 12:04d}-{oldest % 12 + 1:02d}":
                    self.state.removeKey((name,))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return Quota()


def quota_stream(events: DataFrame, limits: quota.Limits = quota.CHAT_TOKENS) -> DataFrame:
    """A stream of events (event_id, user_id, ts, kind, amount) as a stream of decisions, like ``quota.fold``: days and months are those of UTC."""
    dated = events.withColumns({"day": T.day_key(F.col("ts")), "month": T.month_key(F.col("ts"))})
    return dated.groupBy("user_id").transformWithStateInPandas(_quota(limits.daily, limits.monthly), ADMISSION, "Append", "None")
