"""Sources and sinks: test tables, files, the vector table, recorded HTTP answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.functions import text as T
from docloom.functions.ship import map_batches
from docloom.functions.stored import new_folder


#: A table between these sizes may be one row group, which one task reads; its rows are dealt to all cores.
SMALL, LARGE = 1 << 20, 64 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is spread over the cores, which a large one is by its files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if SMALL < size < LARGE else df


scratch = new_folder


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, stem, length, head (first 1024 bytes as text), content of ``*.pdf`` in a folder, not below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), T.stem(F.col("path")).alias("stem"), "length", F.decode(F.substring("content", 1, 1024), "ISO-8859-1").alias("head"), "content")


def page_method(text):
    """``digital`` for a page with more than 50 characters of text, else ``ocr``."""
    return F.when(F.length(T.strip(F.coalesce(text, F.lit("")))) > 50, "digital").otherwise("ocr")


def kb_path(kb_id, doc_id):
    """Where an uploaded file is kept: a folder for each knowledge base."""
    return F.concat(kb_id.cast("string"), F.lit("/"), doc_id.cast("string"), F.lit(".pdf"))


def form_feed_pages(content: bytes) -> list[str]:
    """The offline parser: pages of text with form feeds between; real ones are passed in its place."""
    return content.decode("utf-8").split("\f")


def no_ocr(content: bytes, page: int) -> str:
    raise ValueError("no OCR is installed")


PAGE = StructType([StructField(n, t) for n, t in (("page_no", LongType()), ("method", StringType()), ("text", StringType()), ("error", StringType()))])
DIGITAL_OVER = 50


def parsed_pages(files: DataFrame, key: str = "path", parse=form_feed_pages, ocr=no_ocr) -> DataFrame:
    """key, page_no, method, text, error of each page of ``files`` (key, content).

    A page with more than DIGITAL_OVER characters of text is taken as it is, others
    go to ``ocr(content, page)``.  What fails leaves an empty text and its error:
    a page for itself, a file that cannot be parsed as its page 1.
    """
    out = StructType([files.schema[key], *PAGE.fields])

    def pages(content: bytes | None):
        try:
            texts = parse(content)
        except Exception as e:
            yield 1, "failed", "", f"{type(e).__name__}: {e}"
            return
        for n, text in enumerate(texts, 1):
            if len((text or "").strip()) > DIGITAL_OVER:
                yield n, "digital", text, None
                continue
            try:
                yield n, "ocr", ocr(content, n), None
            except Exception as e:
                yield n, "ocr", "", f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(name, *p) for p in pages(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(out.fields)], names=out.fieldNames())

    return map_batches(files.select(key, "content"), run, out)


def chapters_of(marks: list[tuple[int, str, int]], page_count: int) -> list[tuple]:
    """Rows (ord, level, title, start_page, page_count) of a parser's bookmarks, for ``structure.page_ranges``."""
    return [(i, level, title, start, page_count) for i, (level, title, start) in enumerate(marks)]


def json_rows(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    """Rows of a list in memory; a key that an item lacks is null."""
    names = StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database's table, read in ``parts`` by ranges of a whole-number ``key``."""
    source = lambda: spark.read.format("jdbc").options(url=url, **options)
    reader = source()
    if key and parts > 1:
        low, high = source().option("query", f"select min({key}) as LOW_KEY, max({key}) as HIGH_KEY from {table}").load().first()
        if low is not None and low < high:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.option("dbtable", table).load()


def append_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def chunk_id():
    """A chunk's id follows from its place and content, so a repeated append can be told."""
    return F.sha2(F.concat_ws("\u0001", "kb_document_id", F.col("chunk_no").cast("string"), "content"), 256)


def append_vectors(chunks: DataFrame, path: str) -> None:
    """Appends to the vector table, one folder for each collection."""
    chunks.withColumn("id", chunk_id()).write.mode("append").partitionBy("collection").parquet(path)


def restore_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All chunks with text, each id once."""
    return spark.read.parquet(path).where("content is not null and content <> ''").dropDuplicates(["id"])


def external_hits(hits: DataFrame, first: int = 3) -> DataFrame:
    """The first hits of each query, and of those the ones that are fragments (in this order)."""
    return hits.where(F.col("position") < first).where("fragment")


def external_chunks(hits: DataFrame, fragments: DataFrame, base_url: str = "https://example.org/doc/") -> DataFrame:
    """Recorded hits and fragments (tid, headline, title) as chunks; hits without a fragment are skipped."""
    joined = external_hits(hits).join(fragments, "tid")
    return joined.select("query_id", "position", T.html_text(F.array_join("headline", " ")).alias("content"), F.col("title").alias("source"), F.col("docsource").alias("court"), F.col("publishdate").alias("date"), F.col("tid").alias("doc_id"), F.concat(F.lit(base_url), F.col("tid").cast("string"), F.lit("/")).alias("url"))


def traced(df: DataFrame, name: str):
    """(df, observation): the frame counts its rows as it runs; ``observation.get`` has the counts afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
