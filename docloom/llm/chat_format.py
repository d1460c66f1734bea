"""Chat formatting at the level of tokens.

A turn is ``### role: text</turn>`` and a line break.  Each segment (role, text)
is encoded by itself and the marks between them are reserved ids that no text can
produce: OPEN, SAYS and CLOSE, numbered from the first id after the vocabulary.
So where a text begins and ends never depends on how its characters merge with
their neighbours, and positions follow from the segments' lengths: a running sum
over the turns gives each turn's place in its conversation, and with it the loss
mask, which holds the tokens of assistant texts and nothing else.

For use as a string, control strings inside a role or text are escaped: a
backslash goes before ``###``, ``</turn>`` and, in roles, ``:``, and each
backslash is doubled.  Escaping is a prefix code, so it can be undone, also over
texts that are joined.

``assemble`` gives one row for each turn; a conversation of any length is never
gathered.  ``read_back`` streams through the turns of each conversation in order.

Defined cases: null roles and texts are empty; rows of one conversation are
ordered by turn, then role, then text (equal rows are all kept); a null conv_id
is one conversation; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import byte_bpe
from .shared import map_batches

MARKS = ("### ", ": ", "</turn>\n")  # OPEN, SAYS, CLOSE
TRAINED_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn_ids(role: str, text: str, encoder: byte_bpe.Encoder) -> tuple[np.ndarray, int, int]:
    """(ids, first token of the text, end of the text) of one turn."""
    mark = encoder.first_unused
    name, said = encoder.ids(escape(role, role=True)), encoder.ids(escape(text))
    ids = np.concatenate([[mark], name, [mark + 1], said, [mark + 2]]).astype(np.int32)
    return ids, len(name) + 2, len(name) + 2 + len(said)


def _ordered(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


_ORDER = ["turn", "role", "text"]


def assemble(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text, ids, and in tokens of the conversation: start, loss_from, loss_to (equal: no loss)."""
    source = _ordered(rows)
    out = StructType([*source.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("text_from", IntegerType()), StructField("text_to", IntegerType())])

    def run(batches):
        encoder = byte_bpe.encoder(path, pattern)
        for batch in batches:
            made = [turn_ids(r, t, encoder) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ends = np.cumsum([0] + [len(m[0]) for m in made]).astype(np.int32)
            flat = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(pa.array([m[i] for m in made], pa.int32()) for i in (1, 2))], names=out.fieldNames())

    turns = source.transform(map_batches, run, out)
    before = Window.partitionBy("conv_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0))
    trained = F.col("role") == TRAINED_ROLE
    return (
        turns.withColumn("start", start)
        .withColumn("loss_from", F.col("start") + F.col("text_from"))
        .withColumn("loss_to", F.when(trained, F.col("start") + F.col("text_to")).otherwise(F.col("loss_from")))
        .drop("text_from", "text_to")
    )


def read_back(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each conversation of ``assemble``'s output, what its tokens and masks say: see the columns."""
    out = StructType(
        [StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType())]
        + [StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
    )

    def run(batches):
        encoder = byte_bpe.encoder(path, pattern)
        mark = encoder.first_unused
        token = encoder.table | {mark + i: m.encode() for i, m in enumerate(MARKS)}
        text_of = lambda ids: b"".join(map(token.__getitem__, ids.tolist())).decode()
        open_, done = None, []

        def close():
            conv, n, turns_sha, loss_chars, loss_sha, chars = open_
            done.append((conv, n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))

        for batch in batches:
            for conv, ids, start, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        close()
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.array(ids, np.int64)
                says, end = (int(np.flatnonzero(ids == mark + i)[0]) for i in (1, 2))
                role, said = unescape(text_of(ids[1:says])), unescape(text_of(ids[says + 1 : end]))
                masked = unescape(text_of(ids[a - start : b - start]))
                open_[1] += 1
                open_[2].update(f"{role}\n{said}\n".encode())
                open_[3] += len(masked)
                open_[4].update(masked.encode())
                open_[5] += len(text_of(ids))
            if len(done) >= 1000:
                yield _rows(done, out)
                done = []
        if open_ is not None:
            close()
        if done:
            yield _rows(done, out)

    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return placed.select("conv_id", "ids", "start", "loss_from", "loss_to").transform(map_batches, run, out)


def _rows(done: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = [pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=schema.fieldNames())
