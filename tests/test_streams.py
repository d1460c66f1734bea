"""Streams as a runner starts them: from another folder, in another zone, with bad documents and restarts."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from docloom.streaming import pipelines

ROOT = str(Path(__file__).resolve().parent.parent)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import datetime as dt
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "Asia/Kolkata").config("spark.sql.streaming.stateStore.providerClass", {rocks!r}).getOrCreate()
from docloom.operators import quota
from docloom.streaming import pipelines
schema = "event_id long, user_id long, ts timestamp, kind string, amount long"
utc = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc)
rows = [(1, 1, utc(2024, 1, 31, 12), "reserve", 600), (2, 1, utc(2024, 1, 31, 20), "reserve", 600), (3, 1, utc(2024, 2, 1, 1), "reserve", 600)]
spark.createDataFrame(rows, schema).coalesce(1).write.parquet({path!r} + "/in")
events = spark.readStream.schema(schema).parquet({path!r} + "/in")
q = pipelines.quota_stream(events).writeStream.format("memory").queryName("d").option("checkpointLocation", {path!r} + "/cp").trigger(availableNow=True).start()
q.awaitTermination(120)
both = [sorted((r.event_id, r.admitted, r.day_used, r.month_used) for r in df.collect()) for df in (spark.table("d"), quota.fold(spark.read.parquet({path!r} + "/in")))]
assert both[0] == both[1] == [(1, True, 600, 600), (2, False, 600, 600), (3, True, 600, 600)], both
print("ALIKE")
"""


def test_quota_stream_elsewhere(tmp_path):
    """20:00 UTC is the next day and month in Kolkata; the package is on the driver's path only."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, rocks=ROCKS, path=str(tmp_path))], cwd="/tmp", env=env, capture_output=True, text=True, timeout=240)
    assert "ALIKE" in done.stdout, done.stderr[-3000:]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def test_a_bad_document_fails_alone_and_keeps_its_tries(spark, rocks, tmp_path):
    path = str(tmp_path)

    def parse(text):
        if text == "bad" or (text == "late" and not os.path.exists(f"{path}/ready")):
            raise ValueError(f"can't read {text}")
        return text.upper()

    spark.createDataFrame([(1, "# a\none two"), (2, "bad"), (3, "late"), (4, "three")], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/in")

    def start():
        return pipelines.ingest(spark, f"{path}/in", "doc_id long, text string", f"{path}/chunks", f"{path}/status", f"{path}/cp", parse, delay=2, trigger={"processingTime": "1 second"})

    def statuses():
        try:
            return {(r.doc_id, r.attempts): (r.status, r.error) for r in spark.read.parquet(f"{path}/status").collect()}
        except Exception:
            return {}

    def wait(until):
        end = time.time() + 90
        while time.time() < end and not until(statuses()):
            time.sleep(1)
        return statuses()

    query = start()
    seen = wait(lambda s: (2, 1) in s)
    assert seen[1, 1] == seen[4, 1] == ("completed", None) and seen[2, 1][0] == seen[3, 1][0] == "retrying"
    query.stop()
    before = max(n for d, n in statuses() if d == 2)
    (tmp_path / "ready").touch()
    query = start()
    seen = wait(lambda s: (2, 3) in s and any(d == 3 and v[0] == "completed" for (d, _), v in s.items()))
    query.stop()
    assert seen[2, 3] == ("failed", "ValueError: can't read bad") and (2, 4) not in seen and before < 3
    assert min(n for (d, n), v in seen.items() if d == 3 and v[0] == "completed") >= 2
    chunks = sorted((r.doc_id, r.structural_path, r.content) for r in spark.read.parquet(f"{path}/chunks").collect())
    assert chunks == [(1, "A", "ONE TWO"), (3, "Root", "LATE"), (4, "Root", "THREE")]
