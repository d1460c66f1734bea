"""Divergence between the sources of a language, and the terms that make it.

Partitions count terms in byte tries (``term_trie``) whose leaves have a counter for
each (lang, source); the tries are cut into leaves, dealt by ranges of (lang, term)
and merged there in order, so that a range of prefixes is one merged trie; terms in
fewer than ``least`` documents of their language go.  Groups' totals come from the
merged tries.  A second pass traverses each range in the order of UTF-8 and streams
two things: for each pair of sources the sum of differences over the terms of the
range, and for each source its best ``top`` terms, ties in the order met.

A term occurs in p = 1 + floor(1000000000 (count + 5) / (N + 5 V)) billionths of a
group; N: the group's occurrences of kept terms, V: the language's kept terms.

A trie in a task is written out when it has ``ENTRIES`` entries or ``WEIGHT`` bytes, so
memory does not grow with the vocabulary; a term has at most one entry for each
trie and group, so no term is hot.  The sources of one language are held in a
task (their names and totals), as the result has all their pairs; sums over pairs
are made for ``SOURCES`` sources at a time.

Defined cases: null text, lang and source are empty strings, and '' is a language
and a source like any other; every (lang, source) that occurs is a group, also
without terms; without kept terms all pairs differ by 0; each row is a document,
also if it repeats another; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .shared import map_batches, stored
from .term_trie import Trie, flatten, traverse

UNIT, SMOOTH = 1_000_000_000, 5  # fixed by the definition of p
ENTRIES, WEIGHT = 1 << 20, 1 << 26
RANGE_TERMS = 4096
SOURCES = 256

LEAF = StructType([StructField(n, t) for n, t in (("lang", StringType()), ("term", StringType()), ("source", StringType()), ("n", LongType()), ("documents", LongType()))])
#: A range: its trie (shared, edges), its sources with their occurrences, and its entries.
RANGE = StructType(
    [StructField("lang", StringType()), StructField("shared", ArrayType(IntegerType())), StructField("edges", ArrayType(BinaryType())), StructField("sources", ArrayType(StringType()))]
    + [StructField("sums", ArrayType(LongType())), StructField("leaf", ArrayType(IntegerType())), StructField("source", ArrayType(IntegerType())), StructField("n", ArrayType(LongType()))]
)
FOUND = StructType([StructField(n, t) for n, t in (("lang", StringType()), ("part", StringType()), ("source", StringType()), ("item", StringType()), ("value", LongType()))])


def leaves(docs: DataFrame) -> DataFrame:
    """lang, term, source, n, documents: the leaves of each task's tries; docs: text, lang, source."""

    def run(batches):
        names: dict[tuple[str, str], int] = {}
        trie = Trie()

        def cut():
            terms, leaf, group, n, documents = trie.merge()
            keys = list(names)
            lang, source = (pa.array([k[i] for k in keys], pa.string()) for i in range(2))
            for a in range(0, len(leaf), 1 << 16):
                at = slice(a, a + (1 << 16))
                own = pa.array(group[at])
                yield pa.RecordBatch.from_arrays([lang.take(own), terms.take(pa.array(leaf[at])).cast(pa.string()), source.take(own), pa.array(n[at]), pa.array(documents[at])], names=LEAF.fieldNames())

        for batch in batches:
            group = [names.setdefault(key, len(names)) for key in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
            trie.add_rows(batch.column(0), np.array(group, np.int64))
            if trie.entries > ENTRIES or trie.weight > WEIGHT:
                yield from cut()
                trie = Trie()
        yield from cut()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return map_batches(docs.select(text("text"), text("lang"), text("source")), run, LEAF)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any column; the first does."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _combined(rows: pa.Table) -> pa.Table:
    """Rows in the order of (lang, term, source), equal ones added."""
    at = np.flatnonzero(_changes(*(rows.column(i).combine_chunks() for i in range(3))))
    sums = [pa.array(np.add.reduceat(rows.column(i).to_numpy(), at)) for i in (3, 4)]
    firsts = rows.select([0, 1, 2]).take(pa.array(at))
    return pa.table([*firsts.columns, *sums], names=LEAF.fieldNames())


def merged(found: DataFrame, least: int) -> DataFrame:
    """The kept terms of ``leaves`` as tries of ranges, each of one language."""

    def pack(rows: pa.Table):
        """rows: whole terms, in order."""
        lang, term, source = (rows.column(i).combine_chunks() for i in range(3))
        new = _changes(lang, term)
        leaf = np.cumsum(new) - 1
        documents = np.add.reduceat(rows.column(4).to_numpy(), np.flatnonzero(new))
        rows = rows.filter(pa.array(documents[leaf] >= least))
        if not rows.num_rows:
            return
        lang, term = (rows.column(i).combine_chunks() for i in range(2))
        new = _changes(lang, term)
        leaf = np.cumsum(new) - 1
        tongue = np.flatnonzero(_changes(lang))
        for a, b in zip(tongue, np.append(tongue[1:], rows.num_rows)):
            for first in range(leaf[a], leaf[b - 1] + 1, RANGE_TERMS):
                lo, hi = a + np.searchsorted(leaf[a:b], [first, first + RANGE_TERMS])
                part = rows.slice(lo, hi - lo)
                shared, edges = flatten(part.column(1).combine_chunks().take(pa.array(np.flatnonzero(new[lo:hi]))).cast(pa.binary()).to_pylist())
                coded = part.column(2).combine_chunks().dictionary_encode()
                own, n = coded.indices.to_numpy(), part.column(3).to_numpy()
                sums = np.zeros(len(coded.dictionary), np.int64)
                np.add.at(sums, own, n)
                one = [lang[lo].as_py(), shared, edges, coded.dictionary.to_pylist(), sums, leaf[lo:hi] - first, own, n]
                kinds = [pa.string(), *(pa.list_(k) for k in (pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)], names=RANGE.fieldNames())

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = _combined(rows if held is None else pa.concat_tables([held, rows]))
            last = int(np.flatnonzero(_changes(rows.column(0).combine_chunks(), rows.column(1).combine_chunks()))[-1])
            held = rows.slice(last)  # the last term may go on
            if last:
                yield from pack(rows.slice(0, last))
        if held is not None:
            yield from pack(held)

    dealt = found.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return map_batches(dealt.select(*LEAF.fieldNames()), run, RANGE)


def shares(counts: np.ndarray, total) -> np.ndarray:
    """p of each count in groups with ``total`` = N + 5 V, exactly."""
    if int(counts.max(initial=0)) + SMOOTH < (1 << 63) // UNIT:
        return 1 + UNIT * (counts + SMOOTH) // total
    return (1 + UNIT * (counts.astype(object) + SMOOTH) // total).astype(np.int64)


def _pairs(p: np.ndarray, leaf: np.ndarray, own: np.ndarray, absent: np.ndarray, n_terms: int):
    """(a, sums): for blocks of sources from a on, their differences from all sources, over n_terms terms."""
    rows = max(1, (1 << 20) // len(absent))
    for a in range(0, len(absent), SOURCES):
        b = min(a + SOURCES, len(absent))
        sums = np.zeros((b - a, len(absent)), np.int64)
        for t in range(0, n_terms, rows):
            lo, hi = np.searchsorted(leaf, [t, t + rows])
            dense = np.repeat(absent[:, None], min(rows, n_terms - t), axis=1)
            dense[own[lo:hi], leaf[lo:hi] - t] = p[lo:hi]
            for i in range(a, b):
                sums[i - a, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
        yield a, sums


def traversed(ranges: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """lang, part, source, item, value: sums over pairs (source < item) and the best terms, range by range.

    totals: lang, v, groups (source and n of each source of the language, in order).
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names = [g["source"] for g in row["groups"]]
                smoothed = np.array([g["n"] for g in row["groups"]], np.int64) + SMOOTH * row["v"]
                number = {name: i for i, name in enumerate(names)}
                own = np.array([number[s] for s in row["sources"]], np.int64)[np.array(row["source"], np.int64)]
                leaf, n = np.array(row["leaf"], np.int64), np.array(row["n"], np.int64)
                terms = traverse(row["shared"], row["edges"])
                p = shares(n, smoothed[own])
                for a, sums in _pairs(p, leaf, own, shares(np.zeros(len(names), np.int64), smoothed), len(terms)):
                    i, j = np.nonzero(np.arange(len(names)) > a + np.arange(len(sums))[:, None])
                    yield _rows(row["lang"], "pair", [names[x + a] for x in i], [names[x] for x in j], sums[i, j])
                whole = np.zeros(len(terms), np.int64)
                np.add.at(whole, leaf, n)
                q = shares(whole, int(smoothed.sum()) - SMOOTH * row["v"] * (len(names) - 1))
                f = p - q[leaf]
                order = np.lexsort((leaf, -f, own))
                order = order[f[order] > 0]
                place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
                best = order[place < top]
                yield _rows(row["lang"], "term", [names[x] for x in own[best]], [terms[x].decode() for x in leaf[best]], f[best])

    given = ranges.join(totals, "lang").select(*RANGE.fieldNames(), "v", "groups")
    return map_batches(given, run, FOUND)


def _rows(lang: str, part: str, source: list[str], item: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value)], names=FOUND.fieldNames())


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: see the module; docs: text, lang, source."""
    found = stored(leaves(docs))
    ranges = stored(merged(found, least))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = ranges.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.sums").alias("n"))
    groups = docs.select(empty("lang"), empty("source")).distinct().join(kept, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = stored(groups)
    totals = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    totals = totals.join(ranges.groupBy("lang").agg(F.sum(F.size("edges").cast("long")).alias("v")), "lang")
    seen = stored(traversed(ranges, totals, top))
    sums = seen.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    all_pairs = one.join(other, "lang").where("source < item")  # the pairs are the result
    pairs = all_pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = seen.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)  # Spark keeps each task's best before it sends any
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
