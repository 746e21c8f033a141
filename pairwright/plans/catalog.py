"""Registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import claims, documents, files, ordered, paired, records, scoring, sequences, streams

_MODULES = (paired, ordered, documents, claims, sequences, streams, files, scoring, records)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
