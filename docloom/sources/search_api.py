"""External search as a Spark data source: one partition for each query, so that calls run in parallel.

``fetch(query)`` returns the hits of a query as dicts; the default reads answers
recorded as JSON files (``<query_id>.json``, a list of hits) from a folder that
every executor can open.  A query whose call fails has one row without a position,
which names the error.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query_id bigint, position int, tid bigint, fragment boolean, docsource string, publishdate string, error string"


class _Query(InputPartition):
    def __init__(self, query_id: int):
        self.query_id = query_id


class _Reader(DataSourceReader):
    def __init__(self, folder: str, queries: list[int], fetch):
        self.folder, self.queries, self.fetch = folder, queries, fetch

    def partitions(self):
        return [_Query(q) for q in self.queries] or [_Query(-1)]

    def read(self, partition):
        try:
            hits = self.fetch(self.folder, partition.query_id)
        except Exception as e:  # the other queries go on; the row says why this one has nothing
            yield partition.query_id, None, None, False, None, None, f"{type(e).__name__}: {e}"
            return
        for i, h in enumerate(hits):
            yield partition.query_id, i, h.get("tid"), h.get("fragment") is True, h.get("docsource"), h.get("publishdate"), None


def recorded(folder: str, query_id: int) -> list[dict]:
    with open(os.path.join(folder, f"{query_id}.json"), encoding="utf-8") as f:
        return json.load(f)


def register(spark: SparkSession, fetch=recorded, name: str = "external_search") -> str:
    """Registers the source; read it with options ``path`` and ``queries`` (a JSON list of ids)."""

    class ExternalSearch(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(self.options.get("path", ""), json.loads(self.options.get("queries", "[]")), fetch)

    spark.dataSource.register(ExternalSearch)
    return name
