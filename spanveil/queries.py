"""All queries of the library by name, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanveil.plans import anonymisation, detections, flows, projects, recognition, scalars

_MODULES = (scalars, detections, anonymisation, flows, projects, recognition)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "ano_01_anonymize_all_patterns"
