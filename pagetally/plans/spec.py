"""Query specification: dimension filters, time preset and bounds as predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions.clock import Bounds, interval_bounds, parse_bound, truncate, utc_now
from pagetally.functions.predicates import where_in
from pagetally.model import FILTER_COLUMNS


@dataclass(frozen=True)
class QuerySpec:
    """All parts are combined with AND.

    ``filters`` maps a filter name to accepted values; an empty or missing list
    means no filter and unknown names are ignored. ``as_of`` is the UTC clock the
    interval is seen from (default: now). ``whole_last_day`` makes a date-only
    ``to`` include everything before the next midnight instead of ending at
    23:59:59.
    """

    filters: Mapping[str, Sequence[str] | None] = field(default_factory=dict)
    interval: str | None = None
    from_: str | datetime | None = None
    to: str | datetime | None = None
    as_of: datetime | None = None
    whole_last_day: bool = False

    def bounds(self) -> list[Bounds]:
        found = []
        if self.interval:
            found.append(interval_bounds(self.interval, self.as_of or utc_now()))
        if self.from_:
            found.append(Bounds(lower=parse_bound(self.from_, "00:00:00")))
        if self.to:
            last = parse_bound(self.to, "23:59:59")
            if self.whole_last_day and isinstance(self.to, str) and len(self.to) == len("2024-01-01"):
                found.append(Bounds(before=truncate(last, "day") + timedelta(days=1)))
            else:
                found.append(Bounds(upto=last))
        return found

    def time_predicates(self) -> list[Column]:
        return [test for b in self.bounds() for test in b.predicates(F.col("timestamp"))]

    def month_predicates(self) -> list[Column]:
        """Bounds on the lake's year and month partitions.

        Catalyst does not derive them from ``timestamp``, and without them every
        month of the table would be opened.
        """
        return [test for b in self.bounds() for test in b.month_predicates(F.col("year"), F.col("month"))]

    def filter_predicates(self) -> list[Column]:
        return [
            where_in(F.col(FILTER_COLUMNS[name]), values)
            for name, values in self.filters.items()
            if values and name in FILTER_COLUMNS
        ]

    def apply(self, page_views: DataFrame) -> DataFrame:
        for test in [*self.time_predicates(), *self.filter_predicates()]:
            page_views = page_views.where(test)
        return page_views
