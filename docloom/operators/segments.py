"""A BM25 index of additive segments: documents come and go without a text being read again.

A segment is made of new documents: their terms and counts (``forward``), and a row
for each range of documents (``blocks``) with the range's postings clustered by term and
the greatest share of a score that a posting of each term can have there.  Counts (df,
documents, lengths) are sums over segments; deleted documents are a segment of their
own with negative counts, and hide what stands in segments before it.  Compaction makes
one segment of the live documents from their terms; ``purge`` deletes what it replaced.

A segment is visible once its totals are written, which is last; a compacted one
names there the segments that it replaces, so readers see the old or the new ones.
One writer at a time; a failed write leaves nothing visible, and its number is used again.

Ranges are made where the documents are read: a task sorts some PIECE postings by the
lengths of their documents and cuts them into ranges of RANGE_DOCS, so no posting is
exchanged and a range has documents of about the same length.  ``top`` is made with the
segment's mean length; with another mean a share grows by at most the quotient of the
two, so bounds stay bounds while the index grows.

Ids are expected once among the live documents (``delete`` and ``add`` to replace one);
an id that was added twice has two entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from docloom.functions import text as T
from docloom.functions.ship import map_batches
from docloom.functions.stored import stored
from docloom.operators import bm25

RANGE_DOCS = 128
#: Postings that a task holds to make ranges of; and those of one range, beyond which it has fewer documents.
PIECE, RANGE_POSTINGS = 1 << 18, 1 << 17
#: Row groups of ``blocks``, whose rows are large: a reader holds one decoded.
ROW_GROUP_BYTES = 8 << 20
#: Ids of deleted documents, or ranges of them, that are given to every task; more are joined by shuffles.
BROADCAST_GONE = 1 << 20


def share(tf: np.ndarray, dl: np.ndarray, made: float) -> np.ndarray:
    """What postings add to a score, over the term's weight; made: the mean length."""
    return tf / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / made))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def sizes(column: pa.ListArray) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different words in order, place of each word among them)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of about PIECE list entries of a column and rows, and how many they are."""
    ends = np.cumsum(sizes(batch.column(column)) + 1)
    a = 0
    while a < batch.num_rows:
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(a, b - a), int(ends[b - 1]) - before
        a = b


def _forward_schema(doc_id: DataType) -> StructType:
    return StructType([StructField("doc_id", doc_id), StructField("dl", LongType()), StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])


def _counted(rows: DataFrame) -> DataFrame:
    """doc_id, dl, terms (different ones, in order), tfs of rows (doc_id, terms with repeats)."""
    out = _forward_schema(rows.schema["doc_id"].dataType)

    def run(batches):
        for batch in batches:
            for part, _ in _slices(batch, 1):
                dl = sizes(part.column(1))
                words, rank = ranked(part.column(1).flatten())
                n = max(len(words), 1)
                key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + rank, return_counts=True)
                at = np.searchsorted(key, np.arange(len(dl) + 1) * n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl), lists(at, words.take(pa.array(key % n))), lists(at, pa.array(tf, pa.int32()))], names=out.fieldNames())

    return map_batches(rows.select("doc_id", "terms"), run, out)


def _ranges(forward: DataFrame, number: int, made: float) -> DataFrame:
    """A row for each range: its documents by slot, terms in order with counts and tops, and the slots and tfs of their postings in a row."""
    doc_id = forward.schema["doc_id"].dataType
    listed = {"doc_ids": doc_id, "dls": LongType(), "terms": StringType(), "counts": IntegerType(), "tops": DoubleType(), "slots": ShortType(), "tfs": IntegerType()}
    out = StructType([StructField("range", LongType()), *(StructField(name, ArrayType(kind)) for name, kind in listed.items())])

    def packed(held: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
        ids, dl, terms, tfs = (pa.concat_arrays([b.column(c) for b in held]) for c in range(4))
        dl, n = dl.to_numpy(), sizes(terms)
        by = np.argsort(dl, kind="stable")
        starts, docs, postings = [0], 0, 0
        for i, x in enumerate(n[by].tolist()):
            if docs == RANGE_DOCS or docs and postings + x > RANGE_POSTINGS:
                starts.append(i)
                docs = postings = 0
            docs, postings = docs + 1, postings + x
        starts = np.array(starts)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        own = np.searchsorted(starts, place, side="right") - 1
        words, rank = ranked(terms.flatten())
        doc = np.repeat(np.arange(len(n)), n)
        block = own[doc] * max(len(words), 1) + rank
        order = np.lexsort((place[doc], block))
        block, doc, tf = block[order], doc[order], tfs.flatten().to_numpy()[order]
        begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        tops = np.maximum.reduceat(share(tf, dl[doc], made), begin) if len(begin) else np.zeros(0)
        of_range = np.arange(len(starts) + 1)
        at_block = np.searchsorted(block[begin] // max(len(words), 1), of_range)
        at_posting = np.searchsorted(own[doc], of_range)
        at_doc = np.r_[starts, len(by)]
        columns = [
            pa.array(first + np.arange(len(starts))), lists(at_doc, ids.take(pa.array(by))), lists(at_doc, pa.array(dl[by])), lists(at_block, words.take(pa.array(block[begin] % max(len(words), 1)))),
            lists(at_block, pa.array(np.diff(np.r_[begin, len(block)]), pa.int32())), lists(at_block, pa.array(tops)), lists(at_posting, pa.array(place[doc] - starts[own[doc]], pa.int16())), lists(at_posting, pa.array(tf, pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    def run(batches):
        first, held, size = (number << 42) + (TaskContext.get().partitionId() << 22), [], 0
        for batch in batches:
            for part, entries in _slices(batch, 2):
                held, size = [*held, part], size + entries
                if size >= PIECE:
                    yield (made_of := packed(held, first))
                    first, held, size = first + made_of.num_rows, [], 0
        if held:
            yield packed(held, first)

    return map_batches(forward.select("doc_id", "dl", "terms", "tfs"), run, out)


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str

    # --- what is visible -------------------------------------------------------

    def _names(self, table: str) -> set[int]:
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        found = files.listStatus(root) if files.exists(root) else []
        done = [f.getPath() for f in found if files.exists(context._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return {int(p.getName().removeprefix("segment=")) for p in done}

    def _read(self, table: str, numbers: set[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/segment={n}" for n in sorted(numbers)])

    def _totals(self) -> list:
        """A row for each visible segment."""
        rows = self._read("totals", names).collect() if (names := self._names("totals")) else []
        replaced = {n for r in rows for n in r.replaces}
        return [r for r in rows if r.segment not in replaced]

    def _kept(self, deleting: bool) -> set[int]:
        return {r.segment for r in self._totals() if r.deleting == deleting}

    def _table(self, table: str) -> DataFrame:
        if not (numbers := self._kept(False)):
            raise ValueError(f"there is no index at {self.path}")
        return self._read(table, numbers)

    def _gone(self) -> DataFrame | None:
        """gone_id, gone: the last segment that deletes an id."""
        if not (numbers := self._kept(True)):
            return None
        gone = self._read("gone", numbers).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("segment").alias("gone"))
        return F.broadcast(gone) if gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE else gone

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, doc_id, ...) of documents that no later segment deletes."""
        if (gone := self._gone()) is None:
            return rows
        return rows.join(gone, rows["doc_id"] == gone["gone_id"], "left").where("gone is null or segment > gone").drop("gone_id", "gone")

    def _places(self) -> DataFrame:
        """segment, range, slot, doc_id, dl of all documents, deleted ones too."""
        each = self._table("blocks").select("segment", "range", F.posexplode(F.arrays_zip("doc_ids", "dls")).alias("slot", "d"))
        return each.select("segment", "range", "slot", F.col("d.doc_ids").alias("doc_id"), F.col("d.dls").alias("dl"))

    def _marked(self, places: DataFrame, how: str) -> DataFrame:
        """The rows of ``blocks`` with ``marked``, the slots of ``places`` (range, slot) in them."""
        marked = stored(places.groupBy("range").agg(F.collect_list(F.col("slot").cast("short")).alias("marked")))  # RANGE_DOCS at most
        marked = F.broadcast(marked) if marked.limit(BROADCAST_GONE // RANGE_DOCS + 1).count() <= BROADCAST_GONE // RANGE_DOCS else marked
        return self._table("blocks").join(marked, "range", how)

    # --- changes ---------------------------------------------------------------

    def add(self, docs: DataFrame) -> int:
        """A segment of ``docs`` (doc_id, text); returns its number."""
        return self._write(_counted(docs.select("doc_id", T.index_terms(F.col("text")).alias("terms"))), [])

    def delete(self, ids: DataFrame) -> int:
        """Takes the live documents with these ids (doc_id) out; returns the segment's number."""
        number = self._next()
        ids = ids.select("doc_id").distinct()
        leaving = stored(self.live(self._places()).join(ids, "doc_id", "left_semi").select("range", "slot", "dl"))
        at = lambda table: f"{self.path}/{table}/segment={number}"
        ids.write.mode("overwrite").parquet(at("gone"))
        out = StructType([StructField("term", StringType()), StructField("n", LongType())])

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    terms, counts, slots, marked = (batch.column(c)[i].values for c in range(4))
                    if not len(terms):
                        continue
                    leaves = np.zeros(RANGE_DOCS, np.int64)
                    leaves[marked.to_numpy()] = 1
                    n = np.add.reduceat(leaves[slots.to_numpy()], offsets(counts.to_numpy())[:-1])
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(n[some])], names=out.fieldNames())

        left = map_batches(self._marked(leaving, "inner").select("terms", "counts", "slots", "marked"), run, out).groupBy("term").agg((-F.sum("n")).alias("df"))
        left.select("term", "df", F.lit(0.0).alias("top"), F.lit(1.0).alias("made")).write.mode("overwrite").parquet(at("terms"))
        self._finish(number, leaving.agg(-F.count("*"), -F.coalesce(F.sum("dl"), F.lit(0))).first(), True, [])
        return number

    def compact(self) -> int:
        """One segment in the place of all."""
        old = [r.segment for r in self._totals()]
        return self._write(self.live(self._table("forward")).select("doc_id", "dl", "terms", "tfs"), old)

    def purge(self) -> None:
        """Deletes the tables of replaced segments, once no reader that began before the compaction is left; their totals stay, so that no number comes again."""
        context = self.spark.sparkContext
        for table in ("forward", "blocks", "terms", "gone"):
            for number in self._names("totals") - {r.segment for r in self._totals()}:
                path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/segment={number}")
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _next(self) -> int:
        return max(self._names("totals"), default=0) + 1

    def _finish(self, number: int, sums, deleting: bool, replaces: list[int]) -> None:
        row = [(int(sums[0]), int(sums[1] or 0), deleting, replaces)]
        self.spark.createDataFrame(row, "n long, total long, deleting boolean, replaces array<long>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/segment={number}")

    def _write(self, rows: DataFrame, replaces: list[int]) -> int:
        number = self._next()
        at = lambda table: f"{self.path}/{table}/segment={number}"
        small = lambda df: df.write.mode("overwrite").option("compression", "zstd")
        small(rows).parquet(at("forward"))
        forward = self.spark.read.schema(_forward_schema(rows.schema["doc_id"].dataType)).parquet(at("forward"))
        sums = forward.agg(F.count("*"), F.sum("dl")).first()
        made = max((sums[1] or 0) / max(sums[0], 1), 1e-9)
        small(_ranges(forward, number, made)).option("parquet.block.size", ROW_GROUP_BYTES).parquet(at("blocks"))
        each = self.spark.read.parquet(at("blocks")).select(F.explode(F.arrays_zip("terms", "counts", "tops")).alias("b"))
        terms = each.groupBy(F.col("b.terms").alias("term")).agg(F.sum("b.counts").alias("df"), F.max("b.tops").alias("top"))
        small(terms.withColumn("made", F.lit(made))).parquet(at("terms"))
        self._finish(number, sums, False, replaces)
        return number

    # --- reading ---------------------------------------------------------------

    def totals(self) -> tuple[int, float]:
        """Live documents and their mean length."""
        rows = self._totals()
        n = sum(r.n for r in rows)
        return n, sum(r.total for r in rows) / n if n else 0.0

    def terms(self) -> DataFrame:
        """term, df, top: live counts, and a bound of a posting's share with today's mean length."""
        grown = F.greatest(F.lit(1.0), F.lit(self.totals()[1]) / F.col("made"))
        found = self._read("terms", {r.segment for r in self._totals()})
        return found.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.col("top") * grown).alias("top")).where("df > 0")

    def grown(self) -> dict[int, float]:
        """By what the tops of each segment's blocks grow with today's mean length."""
        made = self._read("terms", self._kept(False)).groupBy("segment").agg(F.max("made").alias("made")).collect()
        return {r.segment: max(1.0, self.totals()[1] / r.made) for r in made}

    def blocks(self) -> DataFrame:
        """The rows of ``blocks`` with ``marked``, the slots of deleted documents (null: none)."""
        if (gone := self._gone()) is None:
            return self._table("blocks").withColumn("marked", F.lit(None).cast("array<smallint>"))
        places = self._places()
        return self._marked(places.join(gone, places["doc_id"] == gone["gone_id"]).where("segment <= gone").select("range", "slot"), "left")

    def lengths(self) -> DataFrame:
        return self.live(self._table("forward").select("segment", "doc_id", "dl")).select("doc_id", "dl")

    def index(self) -> bm25.Index:
        """The live index as tables."""
        each = self._table("forward").select("segment", "doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("segment", F.col("e.terms").alias("term"), "doc_id", F.col("e.tfs").cast("long").alias("tf"))
        n, mean = self.totals()
        totals = self.spark.createDataFrame([(n, mean)], "n long, avgdl double")
        return bm25.Index(self.live(each).select("doc_id", "term", "tf"), self.lengths(), self.terms().select("term", "df"), totals)
