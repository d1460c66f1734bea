"""BM25 top-k by score bounds: postings that can't reach the k-th place are not scored.

A query's terms are taken in the order of what they can add at most (weight times the
term's greatest share).  Three rounds over the ranges of ``segments``:

1. the first terms, up to half of what all can add: partial scores, whose k-th
   greatest is a threshold for each query, for a score can only grow;
2. more terms, until what is left can't reach the threshold by itself: from here on no
   new document can get a place, and the threshold is taken again;
3. documents whose partial score and the rest reach the threshold stay; for the
   remaining terms only blocks in ranges of such documents are looked at, first
   by their greatest shares, and entries only where a document still can win.

A range has all postings of its documents, so a task scores it by itself: rounds 1 and
2 send the k best partial scores of a query from each task, round 3 the documents that
reach the k-th place of their task and the threshold.  Queries come in batches of about
PAIRS (query, term) pairs, which all tasks get.

Results are those of ``bm25.search`` over the live documents.  Frequent terms of a
query are mostly in the third round, so their long lists are not scored.  ``EPSILON``
covers the rounding of scores, which decides ties.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docloom.functions.ship import map_batches
from docloom.functions.stored import stored
from docloom.operators import bm25
from docloom.operators.segments import Segments, offsets, ranked, share

EPSILON = 1e-5
PAIRS = 25_000
HELD = 1 << 18  # documents that a task keeps before it drops those that others have passed


@dataclass(frozen=True)
class Found:
    """scores(query_id, doc_id, score), exact, of documents that can be among the best.

    work(query_id, postings, scored, read): postings of its terms, those that were scored, and those in blocks that were opened.
    """

    scores: DataFrame
    work: DataFrame


def _expanded(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the stretch, place) of every place in stretches of places."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(count) - count), count)


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place."""
    return np.bincount(at, values, n).astype(np.float64)  # numpy gives integers where there are no values


@dataclass(frozen=True)
class _Pairs:
    """(query, term) pairs by term: those of a term i are at[i] to at[i + 1] in query and w."""

    query: np.ndarray
    w: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(terms: int, term: np.ndarray, query: np.ndarray, w: np.ndarray) -> "_Pairs":
        order = np.argsort(term, kind="stable")
        return _Pairs(query[order], w[order], np.searchsorted(term[order], np.arange(terms + 1)))

    def blocks(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, query, w) of all pairs of blocks with these terms."""
        block, pair = _expanded(self.at[term], self.at[term + 1] - self.at[term])
        return block, self.query[pair], self.w[pair]


@dataclass(frozen=True)
class _Range:
    """The blocks of a range that have a term of the queries: their term, top, and entries begin to begin + count of slot and part (share of a score)."""

    term: np.ndarray
    top: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    part: np.ndarray
    docs: int

    def entries(self, block: np.ndarray, query: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, slot, what is added) of all postings of some pairs' blocks."""
        of, at = _expanded(self.begin[block], self.count[block])
        return query[of], self.slot[at], w[of] * self.part[at]

    def sums(self, pairs: _Pairs, queries: int) -> np.ndarray:
        """[query, slot]: scores by these pairs."""
        query, slot, added = self.entries(*pairs.blocks(self.term))
        return _added(query * self.docs + slot, added, queries * self.docs).reshape(queries, self.docs)


def _read(batch: pa.RecordBatch, terms: pa.Array, mean: float, grown: dict[int, float]):
    """(ids, _Range) of each row of segment, doc_ids, dls, terms, counts, tops, slots, tfs, marked."""
    for i in range(batch.num_rows):
        segment = batch.column(0)[i].as_py()
        ids, dl, words, count, top, slot, tf = (batch.column(c)[i].values for c in range(1, 8))
        gone = batch.column(8)[i].values
        dl, count, slot = dl.to_numpy(), count.to_numpy().astype(np.int64), slot.to_numpy().astype(np.int64)
        term = pc.index_in(words, terms).fill_null(-1).to_numpy()
        hit = np.flatnonzero(term >= 0)
        block, at = _expanded(offsets(count)[hit], count[hit])
        slot, tf = slot[at], tf.to_numpy()[at]
        if gone is not None and len(gone):
            lives = np.ones(len(dl), bool)
            lives[gone.to_numpy()] = False
            kept = lives[slot]
            block, slot, tf = block[kept], slot[kept], tf[kept]
        count = np.bincount(block, minlength=len(hit)).astype(np.int64)
        yield ids, _Range(term[hit], top.to_numpy()[hit] * grown.get(segment, 1.0), offsets(count)[:-1], count, slot, share(tf, dl[slot], mean), len(dl))


def _better(best: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """[query, place]: the best of each row of both, in any order."""
    both = np.concatenate([best, scores], axis=1)
    return np.partition(both, both.shape[1] - best.shape[1], axis=1)[:, -best.shape[1] :]


def _batch(blocks: DataFrame, wanted: DataFrame, mean: float, grown: dict[int, float], k: int) -> tuple[DataFrame, DataFrame]:
    """For a batch of queries: query_id, doc_id, score of documents, with rows of query_id, late, touched; and query_id, postings, early."""
    rows = wanted.toArrow()  # about PAIRS
    column = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    terms, term = ranked(pc.cast(rows.column("term").combine_chunks(), pa.string()))
    names, query = np.unique(column("query_id"), return_inverse=True)
    w, left, first, n = column("w"), column("left"), column("first").astype(bool), len(names)
    pairs = lambda of: _Pairs.of(len(terms), term[of], query[of], w[of])
    scored = StructType([StructField("query", LongType()), StructField("score", DoubleType())])

    def threshold(early: np.ndarray) -> np.ndarray:
        """The k-th best partial score of each query; 0 where there are fewer."""
        given = pairs(early)

        def run(batches):
            best = np.zeros((n, k))
            for batch in batches:
                for _, r in _read(batch, terms, mean, grown):
                    best = _better(best, r.sums(given, n))
            of, place = np.nonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(best[of, place])], names=scored.fieldNames())

        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        found = map_batches(blocks, run, scored).withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).toArrow()  # a row for each query of the batch
        theta = np.zeros(n)
        theta[found.column("query").to_numpy()] = found.column("score").to_numpy()
        return theta

    theta = threshold(first)
    rest = ~first & (left + EPSILON < theta[query])
    theta = threshold(~rest)
    early, later = pairs(~rest), pairs(rest)
    most = np.zeros(n)
    np.maximum.at(most, query[rest], left[rest])
    out = StructType([wanted.schema["query_id"], StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), StructField("score", DoubleType()), StructField("late", LongType()), StructField("touched", LongType())])
    named, kinds = pa.array(names, to_arrow_type(out["query_id"].dataType)), [to_arrow_type(f.dataType) for f in out.fields]

    def only(able, block, query, w):
        kept = able[query]
        return block[kept], query[kept], w[kept]

    def winners(held, best):
        """Documents that can have a place: of equal scores those of the k smallest ids."""
        of, score, ids = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held]))
        order = np.lexsort((pc.rank(ids, null_placement="at_start").to_numpy(), -score, of))
        kept = order[score[order] + EPSILON >= best.min(axis=1)[of[order]]]
        of, score = of[kept], score[kept]
        alike = np.r_[False, (of[1:] == of[:-1]) & (score[1:] == score[:-1])][: len(of)]
        first = np.flatnonzero(~alike)
        few = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)])) < k
        return of[few], score[few], ids.take(pa.array(kept[few]))

    def sent(of, score, ids):
        none = pa.nulls(len(of), pa.int64())
        return pa.RecordBatch.from_arrays([named.take(pa.array(of)), ids, pa.array(score), none, none], names=out.fieldNames())

    def run(batches):
        best, late, touched, held, size = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for batch in batches:
            for ids, r in _read(batch, terms, mean, grown):
                scores = r.sums(early, n)
                able = (scores > 0) & (scores + (most + EPSILON)[:, None] >= theta[:, None])
                able_query = able.any(axis=1)
                block, of, weight = only(able_query, *later.blocks(r.term))
                more = _added(of, weight * r.top[block], n)
                able &= scores + (more + EPSILON)[:, None] >= theta[:, None]
                able_query = able.any(axis=1)
                block, of, weight = only(able_query, block, of, weight)
                touched += np.bincount(of, r.count[block], n).astype(np.int64)
                of, slot, added = r.entries(block, of, weight)
                kept = able[of, slot]
                late += np.bincount(of[kept], minlength=n)
                scores += _added(of[kept] * r.docs + slot[kept], added[kept], n * r.docs).reshape(n, r.docs)
                some = np.flatnonzero(able_query)
                best[some] = _better(best[some], np.where(able[some], scores[some], 0.0))
                of, slot = np.nonzero(able & (scores + EPSILON >= np.maximum(theta, best.min(axis=1))[:, None]))
                held, size = [*held, (of, scores[of, slot], ids.take(pa.array(slot)))], size + len(of)
                if size > HELD:
                    held = [winners(held, best)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield sent(*held[0])
                        held, size = [], 0
        if held:
            yield sent(*winners(held, best))
        yield pa.RecordBatch.from_arrays([named, pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.array(late), pa.array(touched)], names=out.fieldNames())

    df = column("df")
    looked = pa.table({"query_id": named, "postings": np.bincount(query, df, n).astype(np.int64), "early": np.bincount(query[~rest], df[~rest], n).astype(np.int64)})
    schema = StructType([out["query_id"], StructField("postings", LongType()), StructField("early", LongType())])
    return map_batches(blocks, run, out), blocks.sparkSession.createDataFrame(looked, schema)


def find(index: Segments, queries: DataFrame, k: int = 10) -> Found:
    n, mean = index.totals()
    weight = F.col("qtf") * bm25.idf(F.lit(n), F.col("df"))
    wanted = bm25._wanted(queries).join(index.terms(), "term").select("query_id", "term", "df", weight.alias("w"), (weight * F.col("top")).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    left = F.sum("most").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))  # what this term and those after it can add
    whole = F.sum("most").over(Window.partitionBy("query_id"))
    wanted = stored(wanted.where("query_id is not null").withColumns({"left": left, "first": left > whole / 2}))
    blocks, grown = index.blocks().select("segment", "doc_ids", "dls", "terms", "counts", "tops", "slots", "tfs", "marked"), index.grown()
    batches = -(-wanted.count() // PAIRS) or 1
    of = F.pmod(F.xxhash64("query_id"), F.lit(batches))
    parts = [_batch(blocks, wanted.where(of == b), mean, grown, k) for b in range(batches)]
    found, looked = (functools.reduce(DataFrame.unionByName, each) for each in zip(*parts))
    found = stored(found)
    work = looked.join(found.groupBy("query_id").agg(F.sum("late").alias("late"), F.sum("touched").alias("touched")), "query_id", "left")
    plus = lambda c: F.col("early") + F.coalesce(F.col(c), F.lit(0))
    scores = found.where("score is not null").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return Found(scores, work.select("query_id", "postings", plus("late").alias("scored"), plus("touched").alias("read")))


def search(index: Segments, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score, as ``bm25.search`` gives them for the live documents."""
    first = index.lengths().select("doc_id").orderBy("doc_id").limit(k)
    return bm25._top(find(index, queries, k).scores, first, queries, k)
