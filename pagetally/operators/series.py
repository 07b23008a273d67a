"""Totals, counts by field and time series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions.clock import UNITS, Bounds, parse_bound, trunc_column


def range_bounds(start: str | datetime | None, end: str | datetime | None) -> Bounds:
    """Inclusive bounds; a bare date means the first or the last second of that day."""
    return Bounds(
        lower=parse_bound(start, "00:00:00") if start else None,
        upto=parse_bound(end, "23:59:59") if end else None,
    )


def between(rows: DataFrame, start: str | datetime | None, end: str | datetime | None) -> DataFrame:
    for test in range_bounds(start, end).predicates(F.col("timestamp")):
        rows = rows.where(test)
    return rows


def count_events(
    rows: DataFrame, start: str | datetime | None = None, end: str | datetime | None = None
) -> DataFrame:
    """Number of rows, all of them or between two inclusive bounds."""
    return between(rows, start, end).agg(F.count("*").alias("count"))


def count_by(rows: DataFrame, field: str) -> DataFrame:
    """(value, count) of one field, largest first. NULL is a group of its own with count 0."""
    return (
        rows.groupBy(F.col(field).alias("value"))
        .agg(F.count(F.col(field)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("value"))
    )


def scale(rows: DataFrame, unit: str) -> DataFrame:
    """(period, count) per hour, day, week, month or year, oldest first; empty periods are left out."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit!r}; known: {', '.join(UNITS)}")
    return (
        rows.groupBy(trunc_column(unit, F.col("timestamp")).alias("period"))
        .agg(F.count("*").alias("count"))
        .orderBy("period")
    )
