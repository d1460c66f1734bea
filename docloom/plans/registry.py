"""Registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import application, documents, retrieval, services

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | application.QUERIES | documents.QUERIES | services.QUERIES
ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | application.ORACLE_SQL | documents.ORACLE_SQL | services.ORACLE_SQL
