"""Sends the package to the executors, so that functions on Arrow batches need no installation there."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def ship(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if getattr(context, "_docloom_core_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="docloom-core-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._docloom_core_shipped = True


def give_back() -> None:
    """Returns freed memory to the system, for a Python worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    ship(df)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)
