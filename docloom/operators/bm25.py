"""BM25 as tables: an inverted index and top-k search with metadata filters.

score(d, q) = sum over the query's terms of idf(t) tf / (tf + k1 (1 - b + b dl / avgdl)),
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)).

Only postings of query terms are exchanged: the terms of up to BROADCAST_TERMS
(query, term) pairs are given to the tasks that read the texts, which drop all other
terms and sum term frequencies before anything is sent.  Postings are sent to their
document, so a task scores its documents by itself and sends k of them for each query,
never the pairs of queries and documents.  With more pairs, the terms of all texts are
summed by document and met by a shuffled join.  Documents without any
query term score 0 and fill up the top k by smallest id; since at most k of them can
be needed, the k smallest allowed ids are enough and no query meets all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from docloom.functions import text as T
from docloom.functions.ship import map_batches
from docloom.functions.stored import stored
from docloom.functions.term_search import CELLS, Weights, best, rounded, word_points, words_of

K1, B = 1.5, 0.75
#: (query, term) pairs that are given to every task; more are joined by shuffles.
BROADCAST_TERMS = 100_000
DIGITS = 6  # scores are ranked at this precision, then by id, so that ties do not depend on the order of a sum


@dataclass(frozen=True)
class Index:
    """postings(doc_id, term, tf), lengths(doc_id, dl), terms(term, df), totals(n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    totals: DataFrame

    TABLES: ClassVar[tuple[str, ...]] = ("postings", "lengths", "terms", "totals")

    def write(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> "Index":
        """Raises if the index is absent."""
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in Index.TABLES))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.index_terms(F.col("text"))).cast("long").alias("dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def build(docs: DataFrame) -> Index:
    """The whole index of ``docs`` (doc_id, text)."""
    postings = docs.select("doc_id", F.explode(T.index_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    lengths = doc_lengths(docs)
    totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), totals)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Corpus of a rebuilt index: the old documents and the new ones, repeats kept."""
    return old.unionByName(new)


def term_stats(index: Index) -> DataFrame:
    n = index.totals.select("n")
    return index.terms.join(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))  # totals is one row


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.index_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _part() -> Column:
    """What a query's term adds to a document's score."""
    return F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _top(scored: DataFrame, first: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of ``scored`` (query_id, doc_id, score); ``first``: the k smallest ids, which fill up with 0."""
    filling = queries.select("query_id").join(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows
    both = scored.unionByName(filling).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_lists(docs: DataFrame, queries: DataFrame, k: int, allowed: dict[str, Column | None]) -> dict[str, DataFrame]:
    """For each name a result list (query_id, rank, doc_id, score), like ``search`` with its condition.

    Texts are tokenised and scored once for all lists: conditions choose among
    scored documents, since statistics are those of all documents.
    """
    conditions = [F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for c in allowed.values()]
    lists = sum((c.cast("long") * (1 << i) for i, c in enumerate(conditions)), F.lit(0).cast("long"))  # a bit for each list that the document is for
    wanted = _wanted(queries)
    pairs = wanted.limit(BROADCAST_TERMS + 1).toArrow()
    if pairs.num_rows <= BROADCAST_TERMS:
        found = _found(docs.select("doc_id", lists.alias("lists"), "text"), pairs, wanted.schema["query_id"], k, len(conditions))
        scored = [found.where(F.col("list") == i) for i in range(len(conditions))]
    else:
        joined = _joined(docs.select("doc_id", lists.alias("lists"), "text"), wanted, all(c is not None for c in allowed.values()))
        scored = [joined.where(F.col("lists").bitwiseAND(F.lit(1 << i)) != 0) for i in range(len(conditions))]
    firsts = [docs.where(c).select("doc_id").orderBy("doc_id").limit(k) for c in conditions]
    return {name: _top(s.select("query_id", "doc_id", "score"), first, queries, k) for name, s, first in zip(allowed, scored, firsts)}


def _found(docs: DataFrame, pairs: pa.Table, query_id: StructField, k: int, n_lists: int) -> DataFrame:
    """list, query_id, doc_id, score: the k best of each query in each piece of the documents, which has all postings of its documents.

    pairs: query_id, term, qtf.
    """
    asked = pairs.column("query_id").combine_chunks().dictionary_encode("encode")
    named, query = asked.dictionary, asked.indices.to_numpy()
    vocabulary = pairs.column("term").combine_chunks().dictionary_encode()
    terms, term = vocabulary.dictionary.cast(pa.large_string()), vocabulary.indices.to_numpy()
    postings = stored(_postings(docs, terms), "postings")
    totals = postings.where("doc_id is null").select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.tfs").alias("n")).where(F.col("terms") < 0)
    totals = {r["terms"]: r["n"] for r in totals.collect()}  # two rows
    n, mean = totals.get(_DOCS, 0), totals.get(_LENGTHS, 0) / max(totals.get(_DOCS, 0), 1)
    df = postings.select(F.explode(F.array_distinct("terms")).alias("term")).where("term >= 0").groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the queries at most
    idf_ = np.zeros(len(terms))
    of = df["df"].to_numpy()
    idf_[df["term"].to_numpy()] = np.log(1.0 + (n - of + 0.5) / (of + 0.5))
    weights = Weights.of(len(terms), term, query, pairs["qtf"].to_numpy() * idf_[term], len(named))
    out = StructType([StructField("list", IntegerType()), query_id, docs.schema["doc_id"], StructField("score", DoubleType())])

    def run(batches):
        step = max(1, CELLS // max(weights.queries, 1))
        for whole in batches:
            for a in range(0, whole.num_rows if weights.queries else 0, step):
                batch = whole.slice(a, step)
                batch = batch.take(pc.sort_indices(batch, [("doc_id", "ascending")], null_placement="at_start"))  # equal scores go by id
                dl, lists = (batch.column(c).fill_null(0).to_numpy() for c in (1, 2))
                size = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
                doc, term = np.repeat(np.arange(len(size)), size), batch.column(3).flatten().to_numpy()
                tf = batch.column(4).flatten().to_numpy()
                kept = np.flatnonzero(term >= 0)
                key, same = np.unique(doc[kept] * len(terms) + term[kept], return_inverse=True)  # rows of one id are one document
                doc, term = key // len(terms), key % len(terms)
                tf = np.bincount(same, tf[kept], len(key))
                part = tf / (tf + K1 * (1 - B + B * dl[doc] / mean)) if len(key) else tf
                scores = rounded(weights.scores(len(size), doc, term, part), DIGITS)
                for i in range(n_lists):
                    at, place = best(np.where(lists >> i & 1, scores, 0.0), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), named.take(pa.array(at)), batch.column(0).take(pa.array(place)), pa.array(scores[at, place])], names=out.fieldNames())

    return stored(map_batches(postings, run, out), "found")


#: Terms of the rows that tell how many documents a task has read and how long they are.
_DOCS, _LENGTHS = -1, -2


def _postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, dl, lists, terms, tfs: the postings of ``terms`` by document, as places; the row without an id has the totals, too.

    Texts are made lower case by Spark and read once; what is exchanged is a row for each posting of ``terms``.
    """
    word = np.packbits(word_points(docs.sparkSession))
    known = pa.concat_arrays([terms, pa.array(T.STOP_WORDS, pa.large_string())])
    made = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("dl", "lists")), StructField("term", IntegerType()), StructField("tf", LongType())])

    def run(batches):
        taken, n, total, kind = np.unpackbits(word).astype(bool), 0, 0, None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, row, words in words_of(batch.column(2), taken):
                place = pc.index_in(words, known).fill_null(-1).to_numpy()
                counted = place < len(terms)  # no stop word
                dl = np.bincount(row[counted], minlength=b - a)
                n, total = n + b - a, total + int(dl.sum())
                hit = np.flatnonzero(counted & (place >= 0))
                key, tf = np.unique(row[hit].astype(np.int64) * len(terms) + place[hit], return_counts=True)
                row = key // max(len(terms), 1)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), pa.array(dl[row]), own.column(1).take(pa.array(row)), pa.array((key - row * len(terms)).astype(np.int32)), pa.array(tf)], names=made.fieldNames())
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(2, kind), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array([_DOCS, _LENGTHS], pa.int32()), pa.array([n, total])], names=made.fieldNames())

    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = map_batches(docs.select("doc_id", "lists", lower.alias("text")), run, made).repartition("doc_id")
    return rows.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.max("lists").alias("lists"), F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))


def _joined(docs: DataFrame, wanted: DataFrame, only_listed: bool) -> DataFrame:
    """query_id, doc_id, score, lists of all documents that have a term of the query, by shuffled joins."""
    # every document also has one posting of the empty term, so that one pass over the texts gives the totals, too;
    # these have no id, so that a task sends one for all its documents
    vocabulary = wanted.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tokens = docs.select("doc_id", "lists", T.index_terms(F.col("text")).alias("terms")).withColumn("dl", F.size("terms").cast("long"))
    said = tokens.select("doc_id", "lists", "dl", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term")).withColumn("doc_id", F.when(F.col("term") != "", F.col("doc_id")))
    postings = (
        said.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"), F.max("lists").alias("lists"), F.sum("dl").alias("all"))
        .join(vocabulary, "term", "left_semi")
    )
    # One exchange serves all uses, and one scoring all lists: each use reads all columns, and conditions are
    # on aggregates, so that neither pruning nor push-down makes the uses differ.
    whole = F.col("tf") + F.col("dl") * 0 + F.col("lists") * 0 + F.col("all") * 0
    empty = F.when(F.col("term") == "", whole)
    totals = postings.agg(F.sum(empty).alias("n"), (F.sum(F.when(F.col("term") == "", F.col("all"))) / F.sum(empty)).alias("avgdl"))
    df = postings.groupBy("term").agg(F.sum((whole > 0).cast("long")).alias("df"))
    found = postings.withColumn("tf", whole)
    found = found.where("lists <> 0") if only_listed else found  # documents of no list need no score
    return found.join(df, "term").join(wanted, "term").join(F.broadcast(totals)).groupBy("query_id", "doc_id").agg(F.sum(_part()).alias("score"), F.max("lists").alias("lists"))  # totals is one row


def search(docs: DataFrame, queries: DataFrame, k: int = 10, allowed: Column | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the top k for each of ``queries`` (query_id, text).

    allowed: a condition on ``docs``; statistics are those of all documents.
    """
    return search_lists(docs, queries, k, {"only": allowed})["only"]


def search_index(index: Index, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Like ``search``, from an index: no text is read.  allowed: doc_id of the documents that may be found."""
    wanted = _wanted(queries)
    lengths = index.lengths if allowed is None else index.lengths.join(allowed.select("doc_id"), "doc_id", "left_semi")
    scored = (
        index.postings.join(wanted, "term").join(index.terms, "term").join(lengths, "doc_id").join(F.broadcast(index.totals))  # totals is one row
        .groupBy("query_id", "doc_id").agg(F.sum(_part()).alias("score"))
    )
    return _top(scored, lengths.select("doc_id").orderBy("doc_id").limit(k), queries, k)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether all tables of an index are there."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    return all(files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")) for name in Index.TABLES)


def keys_filter(wanted: dict[str, str | None]) -> Column:
    """A condition from any subset of keys: those that are given must all be equal; a key that a row lacks is no match."""
    condition = F.lit(True)
    for column, value in wanted.items():
        if value:
            condition = condition & F.coalesce(F.col(column) == value, F.lit(False))
    return condition


def all_given(wanted: dict[str, str | None]) -> bool:
    """The user's own store is asked only if every key is given."""
    return all(wanted.values())


def posting_sets(docs: DataFrame, attribute: str) -> DataFrame:
    """Value of an attribute (empty ones are not indexed) and its documents, as counts and bounds."""
    return docs.where(F.col(attribute).isNotNull() & (F.col(attribute) != "")).groupBy(F.col(attribute).alias("value")).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
