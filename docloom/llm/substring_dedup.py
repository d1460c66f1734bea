"""Substring dedup: spans of words that repeat across documents, over a de Bruijn graph.

A window is K consecutive words of one document.  In the graph the (K-1)-word
sequences are nodes and the windows are edges; an edge is repeated when it
starts in two documents or more, and its source is the place in the document
with the smallest id where it starts.  A word is removed when a window that
covers it has a source in a document with a smaller id.

Steps, each a Spark job over rows much smaller than the texts:

1. ``_texts``: size and digest of each word sequence.  Of documents with one
   word sequence only the one with the smallest id goes on (the source of the
   others, which are removed whole).
2. ``_candidates``: a window's *seed* is the smallest hash of its SEED-word
   subsequences; equal windows have equal seeds, and neighbouring windows share
   theirs, so about one row for five words is shuffled.  Windows whose seed
   occurs in one text only can't be repeated and are left out.
3. ``_paths``: runs of candidate windows as walks over nodes (64-bit hashes), kept
   as a table; ``_edges``: their steps as edges (two nodes: 128 bits), grouped to
   sources; unique edges stay out.
4. ``_spans``: a node is nonbranching when one repeated edge enters and one
   leaves it.  Edges join their nodes' degrees, occurrences join their edges, and
   a document's consecutive occurrences that follow one path are compacted into
   one span with its source coordinates; position minus source position is
   constant along the span.
5. ``_verified``: the words at a span and at its source coordinates are read from
   the two texts and compared by a 128-bit digest that shares nothing with the
   node hashes; a span that differs is dropped.

Rows are combined before each shuffle (a window of a copied passage is one row
for each slice of documents), and the two large joins have plain equi-join
shuffles whose hot partitions adaptive execution splits.  Texts are worked on in
slices of about 1 MB and list columns in slices of _NODES numbers, whatever an
Arrow batch holds.

Defined cases: null and empty texts have no words and keep everything; texts of
fewer than K words lose nothing; rows with a null id are left as they are;
identical rows get identical results; of different texts under one id each is
searched and compared by itself, and the windows of all of them start at that id.
Such texts are told apart by a *variant*: 0 for the one with the smallest digest,
else the hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import kernel
from .shared import cut, discard, map_batches, release, stored, with_text_columns

K = 13
SEED = 5
#: Numbers of a list column that are worked on at a time.
_NODES = 1 << 18


def _joined(words: kernel.Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """Words of row i, or those of them that are kept, with one space between."""
    pieces = words.text(i).split()
    if keep is not None:
        pieces = [p for p, k in zip(pieces, keep.tolist()) if k]
    return b" ".join(pieces)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, sha256 of all words, source (smallest id with these words), variant (see above)."""
    made = StructType([StructField("n_words", LongType()), StructField("sha256", StringType())])

    def fn(texts: pa.Array) -> list[pa.Array]:
        counts, shas = [np.zeros(0, np.int64)], []
        for _, _, words in kernel.word_slices(texts):
            counts.append(words.counts())
            shas += [hashlib.sha256(_joined(words, i)).hexdigest() for i in range(words.rows)]
        return [pa.array(np.concatenate(counts), pa.int64()), pa.array(shas, pa.string())]

    each = with_text_columns(docs.withColumn("text_hash", F.xxhash64("text")), "text", made, fn, ["doc_id", "text_hash"])
    each = cut(each)
    # a table of its own, so that the join below deals both sides anew and a large group of copies can be split
    source = cut(each.groupBy("sha256").agg(F.min("doc_id").alias("source")))
    chosen = each.groupBy("doc_id").agg(F.min("sha256").alias("chosen"))
    return cut(
        each.join(source, "sha256").join(chosen, "doc_id", "left")
        .withColumn("variant", F.when(F.col("chosen") == F.col("sha256"), F.lit(0)).otherwise(F.col("text_hash")).cast("long"))
        .drop("chosen")
    )


def _seed_runs(words: kernel.Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, seed) of runs of windows with one seed."""
    hashes = words.hashes()
    first = kernel.window_starts(words.word_off, k)
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    every = np.arange(len(hashes) - seed + 1)
    least = kernel.window_minimum(kernel.window_hashes(hashes, every, seed), k - seed + 1)[first]
    row = words.row_of_word()[first]
    begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    size = np.diff(np.r_[begin, len(first)])
    return row[begin], first[begin] - words.word_off[row[begin]], size, least[begin]


def _candidates(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """text_hash, runs: the windows (first << 32 | count) of a text whose seed occurs in two texts or more."""
    source = docs.where("doc_id is not null").select(F.xxhash64("text").alias("text_hash"), "text")
    seen = StructType([StructField("seed", LongType()), StructField("low", LongType()), StructField("high", LongType())])
    placed = StructType([StructField("seed", LongType()), StructField("text_hash", LongType()), StructField("run", LongType())])

    def texts_of_seeds(batches):
        for batch in batches:
            for _, _, words in kernel.word_slices(batch.column(1)):
                row, _, _, seeds = _seed_runs(words, k, seed)
                if not len(seeds):
                    continue
                mark = np.frombuffer(b"".join(hashlib.blake2b(_joined(words, i), digest_size=8).digest() for i in range(words.rows)), np.int64)
                order = np.lexsort((mark[row], seeds))
                s, m = seeds[order], mark[row][order]
                begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                end = np.r_[begin[1:], len(s)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(s[begin])), pa.array(m[begin]), pa.array(m[end])], names=seen.fieldNames())

    def places_of_seeds(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, words in kernel.word_slices(batch.column(1)):
                row, first, size, seeds = _seed_runs(words, k, seed)
                if len(seeds):
                    yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(seeds)), pa.array(ids[a + row]), pa.array((first << 32) | size)], names=placed.fieldNames())

    shared = source.transform(map_batches, texts_of_seeds, seen).groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("seed")
    places = source.transform(map_batches, places_of_seeds, placed)
    return places.join(shared, "seed", "left_semi").groupBy("text_hash").agg(F.collect_set("run").alias("runs"))


def _windows_of(runs: list[int], n: int) -> np.ndarray:
    """Window numbers below n in runs packed by _candidates."""
    packed = np.unique(np.array(runs, np.int64))
    first, size = packed >> 32, packed & 0xFFFFFFFF
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.minimum(first, n), 1)
    np.add.at(edges, np.minimum(first + size, n), -1)
    return np.flatnonzero(np.cumsum(edges)[:n] > 0)


def _paths(searched: DataFrame, k: int) -> DataFrame:
    """doc_id, variant, at, nodes: runs of consecutive candidate windows of a document; window at + i goes from node i to node i + 1."""
    out = StructType([StructField("doc_id", LongType()), StructField("variant", LongType()), StructField("at", IntegerType()), StructField("nodes", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            ids, variants, runs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, _, words in kernel.word_slices(batch.column(2)):
                hashes = words.hashes()
                picked, row = [], []
                for i in range(words.rows):
                    n = words.word_off[i + 1] - words.word_off[i] - k + 1
                    if n > 0:
                        w = _windows_of(runs[a + i].as_py(), n)
                        picked.append(w + words.word_off[i])
                        row.append(np.full(len(w), i))
                if not picked or not sum(map(len, picked)):
                    continue
                first, row = np.concatenate(picked), np.concatenate(row)
                begin = np.flatnonzero(np.r_[True, (first[1:] != first[:-1] + 1) | (row[1:] != row[:-1])])
                size = np.diff(np.r_[begin, len(first)]) + 1
                ends = np.cumsum(size)
                place = np.repeat(first[begin] - (ends - size), size) + np.arange(int(ends[-1]))
                nodes = kernel.signed(kernel.window_hashes(hashes, np.arange(len(hashes) - k + 2), k - 1)[place])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(nodes))
                at = (first[begin] - words.word_off[row[begin]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row[begin]]), pa.array(variants[a + row[begin]]), pa.array(at), lists], names=out.fieldNames())

    return searched.select("doc_id", "variant", "text", "runs").transform(map_batches, run, out)


_EDGE = [StructField("head", LongType()), StructField("tail", LongType())]


def _occurrences(paths: DataFrame, combine: bool) -> DataFrame:
    """Windows as edges with their places; combine: one row for each edge of some thousand runs, with its source there."""
    names = ["source", "source_variant", "source_at"] if combine else ["doc_id", "variant", "at"]
    fields = [StructField(n, t) for n, t in zip(names, (LongType(), LongType(), IntegerType()))] + [StructField("last", LongType())] * combine
    out = StructType(_EDGE + fields)

    def run(batches):
        for ids, variants, ats, lists in _list_slices(batches, 3):
            size = np.diff(_list_offsets(lists)) - 1
            nodes = _flat(lists)
            run_at = np.cumsum(size + 1) - (size + 1)
            place = np.repeat(run_at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            head, tail = nodes[place], nodes[place + 1]
            doc, variant = np.repeat(ids.to_numpy(), size), np.repeat(variants.to_numpy(), size)
            at = (np.repeat(ats.to_numpy() - run_at, size) + place).astype(np.int32)
            if not combine:
                columns = [head, tail, doc, variant, at]
            else:
                order = np.lexsort((at, variant, doc, tail, head))
                head, tail, doc, variant, at = (x[order] for x in (head, tail, doc, variant, at))
                begin = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
                end = np.r_[begin[1:], len(head)] - 1
                columns = [head[begin], tail[begin], doc[begin], variant[begin], at[begin], doc[end]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=out.fieldNames())

    return paths.transform(map_batches, run, out)


def _edges(paths: DataFrame) -> DataFrame:
    """Repeated edges: head, tail, source, source_variant, source_at.

    The two ``min_by`` take one row, since they see the same rows in the same order;
    if they did not, ``_verified`` would drop the span.
    """
    return (
        _occurrences(paths, combine=True)
        .groupBy("head", "tail")
        .agg(F.min("source").alias("source"), F.min_by("source_variant", "source").alias("source_variant"), F.min_by("source_at", "source").alias("source_at"), F.max("last").alias("last"))
        .where("source < last").drop("last")
    )


def _with_branching(edges: DataFrame) -> DataFrame:
    """``edges`` with plain: whether their head is a nonbranching node."""
    entering = edges.groupBy(F.col("tail").alias("head")).agg(F.count("*").alias("entering"))
    leaving = edges.groupBy("head").agg(F.count("*").alias("leaving"))
    plain = entering.join(leaving, "head").where("entering = 1 and leaving = 1").select("head", F.lit(True).alias("plain"))
    return edges.join(plain, "head", "left").withColumn("plain", F.coalesce("plain", F.lit(False)))


def _spans(paths: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """doc_id, variant, at, n, source, source_variant, source_at: spans of a document as arrays, in its order, where a source is earlier."""
    kinds = {"at": IntegerType(), "n": IntegerType(), "source": LongType(), "source_variant": LongType(), "source_at": IntegerType()}
    out = StructType([StructField(c, LongType()) for c in ("doc_id", "variant")] + [StructField(c, ArrayType(t)) for c, t in kinds.items()])

    def run(batches):
        for ids, variants, *lists in _list_slices(batches, 2):
            at, source, variant, there, plain = (_flat(x) for x in lists)
            row = np.repeat(np.arange(len(ids)), np.diff(_list_offsets(lists[0])))
            order = np.lexsort((at, row))
            row, at, source, variant, there, plain = (x[order] for x in (row, at, source, variant, there, plain))
            fresh = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])][: len(row)]  # an identical row gives its places again
            row, at, source, variant, there, plain = (x[fresh] for x in (row, at, source, variant, there, plain))
            on = np.zeros(len(row), bool)
            on[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (variant[1:] == variant[:-1]) & (there[1:] == there[:-1] + 1) & plain[1:]
            begin = np.flatnonzero(~on)
            size = np.diff(np.r_[begin, len(row)]) + k - 1
            cuts = np.searchsorted(row[begin], np.arange(len(ids) + 1)).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (at[begin], size.astype(np.int32), source[begin], variant[begin], there[begin])]
            yield pa.RecordBatch.from_arrays([ids, variants, *made], names=out.fieldNames())

    places = _occurrences(paths, combine=False)
    found = places.join(_with_branching(edges), ["head", "tail"]).where("source < doc_id")
    names = ("at", "source", "source_variant", "source_at", "plain")
    steps = found.groupBy("doc_id", "variant").agg(F.collect_list(F.struct(*names)).alias("steps"))
    return steps.select("doc_id", "variant", *[F.col(f"steps.{c}").alias(c) for c in names]).transform(map_batches, run, out)


def _list_offsets(column: pa.Array) -> np.ndarray:
    return column.offsets.to_numpy().astype(np.int64)


def _flat(column: pa.Array) -> np.ndarray:
    offsets = _list_offsets(column)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)


def _list_slices(batches, of: int):
    """The columns of some rows at a time; the lists of column ``of`` have about _NODES numbers together."""
    for batch in batches:
        if batch.num_rows:
            for a, b in kernel.row_slices(_list_offsets(batch.column(of)), _NODES):
                yield [c.slice(a, b - a) for c in batch.columns]


def _verified(docs: DataFrame, spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored ``spans`` (which are deleted) whose words are those at their source coordinates, with text_hash.

    docs: doc_id, variant and text of the rows that the spans are in.  Each place that is
    named, as a span or as a source, is read once.
    """
    names = ("at", "n", "source", "source_variant", "source_at")
    each = spans.select("doc_id", "variant", F.explode(F.arrays_zip(*names)).alias("s")).select("doc_id", "variant", "s.*")
    each = stored(each)
    discard(spans)
    there = each.select(F.col("source").alias("doc_id"), F.col("source_variant").alias("variant"), F.col("source_at").alias("at"), "n")
    places = each.select("doc_id", "variant", "at", "n").unionByName(there).distinct()
    places = places.groupBy("doc_id", "variant").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    out = StructType([StructField("doc_id", LongType()), StructField("variant", LongType()), StructField("at", IntegerType()), StructField("n", IntegerType()), StructField("digest", BinaryType())])

    def run(batches):
        for batch in batches:
            ids, variants, ats, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3), batch.column(4)
            for a, b, words in kernel.word_slices(batch.column(2)):
                at, n = _flat(ats.slice(a, b - a)), _flat(sizes.slice(a, b - a))
                each = np.diff(_list_offsets(ats.slice(a, b - a)))
                first = at + np.repeat(words.word_off[:-1], each)
                digests = [_digest(words, x, y) for x, y in zip(first.tolist(), (first + n).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], each)), pa.array(np.repeat(variants[a:b], each)), pa.array(at), pa.array(n), pa.array(digests, pa.binary())], names=out.fieldNames())

    read = stored(docs.join(places, ["doc_id", "variant"]).select("doc_id", "variant", "text", "at", "n").transform(map_batches, run, out).distinct())
    there = read.withColumnsRenamed({"doc_id": "source", "variant": "source_variant", "at": "source_at", "digest": "there"})
    true = each.join(read, ["doc_id", "variant", "at", "n"]).join(there, ["source", "source_variant", "source_at", "n"]).where("digest = there")
    whole = true.groupBy("doc_id", "variant").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s")).select("doc_id", "variant", *[F.col(f"s.{c}").alias(c) for c in names])
    whole = stored(whole.join(chosen, ["doc_id", "variant"]).drop("variant"))
    discard(each, read)
    return whole


def _digest(words: kernel.Words, first: int, end: int) -> bytes:
    """Digest of the words with one space between."""
    stretch = words.data[words.starts[first] : words.ends[end - 1]].tobytes()
    return hashlib.blake2b(b" ".join(stretch.split()), digest_size=16).digest()


def repeated_spans(docs: DataFrame, k: int = K, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of ``docs`` (doc_id, text); see _texts and _spans.

    Copies of a whole text (texts.source < doc_id) have no rows in spans.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = _texts(docs)
    runs = stored(_candidates(docs, k, seed))
    chosen = texts.where("source = doc_id").select("doc_id", "text_hash", "variant").distinct()
    searched = _keyed(docs).join(runs.join(chosen, "text_hash"), ["doc_id", "text_hash"])
    paths = stored(_paths(searched, k))
    discard(runs)
    release(docs.sparkSession)
    edges = stored(_edges(paths))
    release(docs.sparkSession)
    spans = stored(_spans(paths, edges, k))
    discard(paths, edges)
    release(docs.sparkSession)
    texts_of = _keyed(docs).join(chosen, ["doc_id", "text_hash"]).select("doc_id", "variant", "text")
    spans = _verified(texts_of, spans, chosen)
    release(docs.sparkSession)
    return texts, spans


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64("text"))


def _removed_words(words: kernel.Words, i: int, at: list[int], n: list[int]) -> np.ndarray:
    total = int(words.word_off[i + 1] - words.word_off[i])
    edges = np.zeros(total + 1, np.int64)
    begin = np.array(at, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + np.array(n, np.int64), -1)
    return np.cumsum(edges[:-1]) > 0


def removal_digests(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words with one space between) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, spans = repeated_spans(docs, k, seed)
    made = StructType([StructField("doc_id", LongType()), StructField("text_hash", LongType()), StructField("n_cut", LongType()), StructField("cut_sha256", StringType())])

    def run(batches):
        for batch in batches:
            n_cut, shas = [], []
            ats, sizes = batch.column(3), batch.column(4)
            for a, _, words in kernel.word_slices(batch.column(2)):
                for i in range(words.rows):
                    gone = _removed_words(words, i, ats[a + i].as_py(), sizes[a + i].as_py())
                    n_cut.append(int(gone.sum()))
                    shas.append(hashlib.sha256(_joined(words, i, ~gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_cut, pa.int64()), pa.array(shas, pa.string())], names=made.fieldNames())

    changed = _keyed(docs).join(spans, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "at", "n").transform(map_batches, run, made).distinct()
    copies = F.expr(f"source < doc_id and n_words >= {k}")
    nothing = hashlib.sha256(b"").hexdigest()
    return texts.join(changed, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words",
        F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated words (and the white space after each) cut out of ``text``, and ``n_removed``.

    No row is dropped: of a text that is a copy of another nothing is left but
    the empty text.
    """
    small = docs.select("doc_id", "text")
    texts, spans = repeated_spans(small, k, seed)
    copies = texts.where(f"source < doc_id and n_words >= {k}").select("doc_id", "text_hash", F.lit(True).alias("__copy")).distinct()
    plan = spans.select("doc_id", "text_hash", F.col("at").alias("__at"), F.col("n").alias("__n"))
    names = [c for c in docs.columns if c not in ("text", "n_removed")]
    joined = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    for extra in (plan, copies):
        extra = extra.withColumnsRenamed({"doc_id": "__id", "text_hash": "__key"})
        joined = joined.join(extra, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__key")), "left").drop("__id", "__key")
    source = joined.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("text"), "__at", "__n", "__copy")
    out = StructType([source.schema[c] for c in names] + [StructField("text", StringType()), StructField("n_removed", LongType())])

    def run(batches):
        for batch in batches:
            column, ats, sizes, copied = (batch.column(len(names) + j) for j in range(4))
            texts_out: list = column.to_pylist()
            n_cut = [0] * len(texts_out)
            for a, _, words in kernel.word_slices(column):
                for i in range(words.rows):
                    if copied[a + i].as_py():
                        texts_out[a + i], n_cut[a + i] = "", int(words.counts()[i])
                    elif ats[a + i].is_valid:
                        gone = _removed_words(words, i, ats[a + i].as_py(), sizes[a + i].as_py())
                        n_cut[a + i] = int(gone.sum())
                        texts_out[a + i] = _without(words, i, gone).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts_out, pa.string()), pa.array(n_cut, pa.int64())], names=out.fieldNames())

    return source.transform(map_batches, run, out)


def _without(words: kernel.Words, i: int, gone: np.ndarray) -> bytes:
    a, b = words.word_off[i], words.word_off[i + 1]
    begin, row_end = words.starts[a:b], int(words.offsets[i + 1])
    until = np.r_[begin[1:], row_end]
    keep = np.ones(row_end - int(words.offsets[i]), bool)
    for x, y in zip(begin[gone] - words.offsets[i], until[gone] - words.offsets[i]):
        keep[x:y] = False
    return words.data[words.offsets[i] : row_end][keep].tobytes()
