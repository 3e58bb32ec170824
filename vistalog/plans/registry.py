"""Every registered query over the given tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detection, files, ingestion, logs, scenarios, scenes

AREAS = (files, ingestion, logs, scenes, detection, scenarios)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in AREAS for name, (query, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, (_, sql) in area.QUERIES.items() if sql}
