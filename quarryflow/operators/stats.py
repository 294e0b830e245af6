"""Counts over judged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import PRIORITIES


def priority_stats(df: DataFrame, *extra: Column, priority: str = "priority") -> DataFrame:
    """One row with a count for each priority, zeros included."""
    return df.agg(*[F.count_if(F.col(priority) == p).alias(f"count_{p.lower()}") for p in PRIORITIES], *extra)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The column's distinct values without the empty string and null, in order."""
    return df.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column)


def column_widths(df: DataFrame, columns: list[str], least: int = 12, most: int = 55) -> DataFrame:
    """The width of each column of a sheet: its longest cell or name and two more, within bounds."""
    return df.agg(*[F.least(F.lit(most), F.greatest(F.lit(least), F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))) + 2)).alias(c) for c in columns])
