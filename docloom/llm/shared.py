"""What the operators need from the session: reliable checkpoints and tables read by Spark."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources.tables import load as table  # noqa: F401  for the queries


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, a temporary one on one machine, an error on more."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint; for small rows."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage with a Parquet table beside the checkpoints; compressed, so for large rows."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._docloom_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made, once nothing that will still run reads them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._docloom_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose frames are gone; results are not touched.

    Spark deletes them when the driver's JVM happens to collect its garbage,
    which a driver with little to do may not do for long.  The first round
    frees the frames, the second what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each context, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_docloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._docloom_shipped = True


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on through later stages, beside a heap that needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with the modules that ``run`` needs."""
    ship(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def with_text_columns(df: DataFrame, text_col: str, made: StructType, fn, keep: list[str] | None = None, after=None) -> DataFrame:
    """``df`` with the columns of ``made``, which ``fn(text column)`` computes a batch at a time.

    fn: from an Arrow string array to a list of Arrow arrays, in the order of
    ``made``; it must depend on nothing but the texts, so that a lost task can
    be run again.  keep: the columns to carry (all, if None).  after: called at the
    end of each task.  A carried column
    with the name of a made one is replaced.
    """
    names = set(made.fieldNames())
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__text"))
    out = StructType([source.schema[c] for c in carried] + list(made.fields))

    def run(batches):
        for batch in batches:
            columns = fn(batch.column(len(carried)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], names=out.fieldNames())
        if after is not None:
            after()

    return map_batches(source, run, out)
