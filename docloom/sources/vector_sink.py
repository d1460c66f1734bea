"""Vector table with commits: rows are seen when the whole append is, and not before.

Each task writes one Parquet file of its own name, in batches of 100 rows, and tells the
driver the file's name and counts.  When all tasks have ended, the driver writes these
as the append's manifest; readers open only files that a manifest names.  A task that is
lost or run twice leaves a file that no manifest names; an append that fails deletes
the files that it was told of.  An append under the name of an earlier one changes
nothing, so that it can be repeated (two appends of one name at the same time are not
told apart).

The folder is one that the driver and all executors can open.  Classes are made in
``register`` and name nothing of this package, so that workers need no installation of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import chunk_id

MANIFEST = "commit string, files array<struct<file:string,rows:bigint,batches:bigint>>"
BATCH = 100


def register(spark: SparkSession, name: str = "committed_vectors") -> str:
    """Registers the sink; options: ``path``, ``commit`` (the append's name; a new one, if absent), ``batch`` (rows)."""
    import json
    import uuid
    from dataclasses import dataclass

    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    rows_of_a_batch = BATCH

    def opened(path: str):
        return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)

    @dataclass
    class Written(WriterCommitMessage):
        file: str
        rows: int
        batches: int

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str, commit: str, batch: int):
            self.path, self.name, self.batch = path, commit, batch

        def write(self, iterator):
            files, root = opened(self.path)
            files.create_dir(f"{root}/data", recursive=True)
            file, writer, rows, batches, held = f"{uuid.uuid4().hex}.parquet", None, 0, 0, []

            def put(table) -> None:
                nonlocal writer, rows, batches
                writer = writer or pq.ParquetWriter(f"{root}/data/{file}", table.schema, filesystem=files)
                writer.write_table(table, row_group_size=self.batch)
                rows, batches = rows + table.num_rows, batches + -(-table.num_rows // self.batch)

            try:
                for part in iterator:  # whole batches are written, the rest waits for the next rows
                    table = pa.Table.from_batches([*held, part])
                    whole = table.num_rows // self.batch * self.batch
                    if whole:
                        put(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                if held:
                    put(pa.Table.from_batches(held))
            finally:
                if writer is not None:
                    writer.close()
            return Written(file, rows, batches)  # without rows there is no file

        def commit(self, messages):
            files, root = opened(self.path)
            told = [m for m in messages if m is not None and m.rows]
            files.create_dir(f"{root}/manifests", recursive=True)
            final = f"{root}/manifests/{self.name}.json"
            if files.get_file_info(final).type != pafs.FileType.NotFound:
                return self.abort(told)
            draft = f"{root}/manifests/_{uuid.uuid4().hex}"  # not read: its name begins with an underscore
            with files.open_output_stream(draft) as out:
                out.write(json.dumps({"commit": self.name, "files": [{"file": m.file, "rows": m.rows, "batches": m.batches} for m in told]}).encode())
            files.move(draft, final)

        def abort(self, messages):
            files, root = opened(self.path)
            for m in messages:
                if m is not None and m.rows:
                    files.delete_file(f"{root}/data/{m.file}")

    class CommittedVectors(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            raise ValueError("this source is only written; vector_sink.restore reads it")

        def writer(self, schema, overwrite):
            if overwrite:
                raise ValueError("vectors are appended")
            return Writer(self.options["path"], self.options.get("commit") or uuid.uuid4().hex, int(self.options.get("batch", rows_of_a_batch)))

    spark.dataSource.register(CommittedVectors)
    return name


def append(chunks: DataFrame, path: str, commit: str | None = None, batch: int = BATCH) -> None:
    """Appends ``chunks`` (collection, kb_document_id, chunk_no, content and others) with their ids, all or none."""
    options = {"path": path, "batch": str(batch)} | ({"commit": commit} if commit else {})
    chunks.withColumn("id", chunk_id()).write.format(register(chunks.sparkSession)).options(**options).mode("append").save()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """commit, files (file, rows, batches) of all appends."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifests")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """All committed chunks with text, each id once."""
    named = [r.file for r in commits(spark, path).select(F.explode("files.file").alias("file")).collect()]  # one name for each task of an append
    if not named:
        raise FileNotFoundError(f"no committed rows in {path}")
    return spark.read.parquet(*[f"{path}/data/{f}" for f in named]).where("content is not null and content <> ''").dropDuplicates(["id"])
