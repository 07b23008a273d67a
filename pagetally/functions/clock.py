"""Time presets and bounds.

All clocks are UTC wall clocks. Bounds are computed once on the driver from
``as_of`` and compared with the bare timestamp column, so that they reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("hour", "day", "week", "month", "year")

# Calendar presets that start at the truncated clock ...
CURRENT = {"hour": "hour", "today": "day", "month_to_date": "month", "year_to_date": "year"}
# ... presets that cover the calendar unit before the current one ...
PREVIOUS = {"yesterday": "day", "last_month": "month", "last_year": "year"}
# ... and presets that reach back from the current minute.
TRAILING = {
    "past_hour": timedelta(hours=1),
    "past_7_days": timedelta(days=7),
    "past_14_days": timedelta(days=14),
    "past_30_days": timedelta(days=30),
}
ALL_TIME = "all_time"
INTERVALS = (*CURRENT, *PREVIOUS, *TRAILING, ALL_TIME)


@dataclass(frozen=True)
class Bounds:
    """``lower <= timestamp``, ``timestamp < before`` and ``timestamp <= upto``."""

    lower: datetime | None = None
    before: datetime | None = None
    upto: datetime | None = None

    def predicates(self, column: Column) -> list[Column]:
        tests = []
        if self.lower is not None:
            tests.append(column >= ntz(self.lower))
        if self.before is not None:
            tests.append(column < ntz(self.before))
        if self.upto is not None:
            tests.append(column <= ntz(self.upto))
        return tests

    def month_predicates(self, year: Column, month: Column) -> list[Column]:
        """The same bounds on year and month partition columns."""
        tests = []
        if self.lower is not None:
            y, m = self.lower.year, self.lower.month
            tests.append((year > y) | ((year == y) & (month >= m)))
        for upper in (self.before, self.upto):
            if upper is not None:
                y, m = upper.year, upper.month
                tests.append((year < y) | ((year == y) & (month <= m)))
        return tests


def ntz(moment: datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(moment.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def truncate(moment: datetime, unit: str) -> datetime:
    """Start of the hour, day, week (Monday), month or year."""
    if unit == "minute":
        return moment.replace(second=0, microsecond=0)
    if unit == "hour":
        return moment.replace(minute=0, second=0, microsecond=0)
    day = datetime.combine(moment.date(), time())
    if unit == "day":
        return day
    if unit == "week":
        return day - timedelta(days=day.weekday())
    if unit == "month":
        return day.replace(day=1)
    if unit == "year":
        return day.replace(month=1, day=1)
    raise ValueError(f"unknown unit: {unit!r}")


def interval_bounds(interval: str, as_of: datetime) -> Bounds:
    """Bounds of a named preset, seen from ``as_of``."""
    if interval == ALL_TIME:
        return Bounds()
    if interval in CURRENT:
        return Bounds(lower=truncate(as_of, CURRENT[interval]))
    if interval in PREVIOUS:
        unit = PREVIOUS[interval]
        end = truncate(as_of, unit)
        # the instant before a unit starts lies in the unit before it
        return Bounds(lower=truncate(end - timedelta(microseconds=1), unit), before=end)
    if interval in TRAILING:
        return Bounds(lower=truncate(as_of, "minute") - TRAILING[interval])
    raise ValueError(f"unknown interval: {interval!r}; known: {', '.join(INTERVALS)}")


def parse_bound(value: str | datetime, default_time: str) -> datetime:
    """A bound given as ISO date, ISO date-time or datetime, rounded to whole seconds."""
    if isinstance(value, datetime):
        moment = value
    elif len(value) == len("2024-01-01"):
        moment = datetime.fromisoformat(f"{value}T{default_time}")
    else:
        moment = datetime.fromisoformat(value)
    moment = moment.replace(tzinfo=None)
    if moment.microsecond >= 500_000:
        moment += timedelta(seconds=1)
    return moment.replace(microsecond=0)


def trunc_column(unit: str, column: Column) -> Column:
    """``date_trunc`` that stays zone-free."""
    if unit not in UNITS and unit not in ("second", "minute"):
        raise ValueError(f"unknown unit: {unit!r}")
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def period_label(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm")


# Accepted range of a unix time in seconds.
UNIX_TIME_MIN = 1105829760
UNIX_TIME_MAX = 253402300799


def is_valid_unix_time(seconds: Column) -> Column:
    return (seconds >= F.lit(UNIX_TIME_MIN)) & (seconds <= F.lit(UNIX_TIME_MAX))


def interval_literal(count: int, unit: str) -> Column:
    """Count and unit as an interval column."""
    slots = {"year": 0, "month": 1, "week": 2, "day": 3, "hour": 4, "minute": 5, "second": 6}
    if unit not in slots:
        raise ValueError(f"unknown unit: {unit!r}")
    parts = [F.lit(0)] * len(slots)
    parts[slots[unit]] = F.lit(count)
    return F.make_interval(*parts)
