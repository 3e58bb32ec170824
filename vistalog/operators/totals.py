"""Totals of one row beside other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``totals``, an aggregate without keys: one row by construction, so it is broadcast."""
    return rows.crossJoin(F.broadcast(totals))
