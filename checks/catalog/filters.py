"""Dimension filters, time presets, bounds and site scope."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import fixtures as fx
from pagetally.model import FILTER_COLUMNS
from pagetally.plans import reports
from pagetally.plans.spec import QuerySpec

QUERIES, SQL = {}, {}

WA = f"with web_analytics as ({fx.sql(fx.WEB_ANALYTICS)})"
AS_OF = datetime(2024, 1, 20, 12, 34, 56)
LATER = datetime(2024, 2, 10, 0, 0, 0)
NEXT_YEAR = datetime(2025, 3, 1, 8, 0, 0)


def views(name, condition, columns="event_id, service_id, \"timestamp\""):
    SQL[name] = f"{WA} select {columns} from web_analytics where {condition}"


def spec_query(name, spec, condition, column=None):
    """Rows that pass a spec, with the filtered column."""
    columns = ["event_id", "service_id", "timestamp"]
    if column and column not in columns:
        columns.append(column)
    QUERIES[name] = lambda s, d: spec.apply(fx.page_views(s, d)).select(*columns)
    views(name, condition, ", ".join(f'"{c}"' for c in columns))


# one filter per dimension: two values that occur, one that does not
VALUES = {
    "utm_sources": ["feed", "nobody"],
    "utm_campaigns": ["spring", "autumn"],
    "utm_mediums": ["rss", "email"],
    "utm_contents": ["cta", "banner"],
    "namespaces": ["www.cheap-pills.example.com", "spam-farm.example.org"],
    "country_codes": ["FR", "DE", "XX"],
    "referrers": ["ref1.example.net", "ref5.example.net"],
    "sources": ["Source1", "Source2"],
    "services": ["svc-0", "svc-7"],
    "operating_systems": ["macOS", "Linux"],
    "operating_system_versions": ["10.15", "11"],
    "browsers": ["Firefox", "Microsoft Edge"],
    "browser_versions": ["101.0", "103.0"],
    "paths": ["/en/471", "/fr/414", "/en/334/"],
}
for _name, _values in VALUES.items():
    _column = FILTER_COLUMNS[_name]
    # Written with OR: DuckDB 2.0.0 folds ``case when c then 'a' end in ('a', 'b')`` to true
    # for the rows where the CASE is NULL; the equality form gives the right rows.
    _any = " or ".join(f"{_column} = '{v}'" for v in _values)
    spec_query(f"filter_{_name}", QuerySpec({_name: _values}), f"({_any})", _column)
    spec_query(
        f"filter_{_name}_or_null",
        QuerySpec({_name: [*_values, ""]}),
        f"({_any} or {_column} is null)",
        _column,
    )

spec_query("filter_only_null", QuerySpec({"utm_campaigns": [""]}), "utm_campaign is null", "utm_campaign")
spec_query(
    "filter_null_and_blank",
    QuerySpec({"utm_campaigns": ["", ""]}),
    "(utm_campaign in ('') or utm_campaign is null)",
    "utm_campaign",
)
spec_query(
    "filter_combined",
    QuerySpec({"country_codes": ["EN"], "browsers": ["Chrome", ""], "utm_campaigns": ["spring", ""]}),
    "country_code = 'EN' and (browser = 'Chrome' or browser is null) and (utm_campaign = 'spring' or utm_campaign is null)",
)
spec_query("filter_skipped", QuerySpec({"paths": [], "browsers": None, "colour": ["red"]}), "true")

# bounds
spec_query("from_date", QuerySpec(from_="2024-01-12"), "\"timestamp\" >= '2024-01-12 00:00:00'::TIMESTAMP_S")
spec_query(
    "from_datetime", QuerySpec(from_="2024-01-12T13:30:00"), "\"timestamp\" >= '2024-01-12 13:30:00'::TIMESTAMP_S"
)
spec_query("to_date", QuerySpec(to="2024-01-12"), "\"timestamp\" <= '2024-01-12 23:59:59'::TIMESTAMP_S")
spec_query(
    "to_datetime", QuerySpec(to=datetime(2024, 1, 12, 13, 30)), "\"timestamp\" <= '2024-01-12 13:30:00'::TIMESTAMP_S"
)
spec_query(
    "to_whole_last_day", QuerySpec(to="2024-01-12", whole_last_day=True), "\"timestamp\" < timestamp '2024-01-13 00:00:00'"
)
spec_query(
    "bounds_fraction_of_second",
    QuerySpec(from_="2024-01-12T00:00:00.9", to="2024-01-14T11:59:59.4"),
    "\"timestamp\" >= '2024-01-12 00:00:00.9'::TIMESTAMP_S and \"timestamp\" <= '2024-01-14 11:59:59.4'::TIMESTAMP_S",
)
spec_query(
    "bounds_with_interval",
    QuerySpec(interval="month_to_date", from_="2024-01-05", to="2024-01-07", as_of=AS_OF),
    "\"timestamp\" >= timestamp '2024-01-05 00:00:00' and \"timestamp\" <= timestamp '2024-01-07 23:59:59'",
)


# presets
def _now(moment):
    return f"timestamp '{moment:%Y-%m-%d %H:%M:%S}'"


def _since(unit, moment):
    return f"\"timestamp\" >= date_trunc('{unit}', {_now(moment)})"


def _before_current(unit, moment):
    start = f"date_trunc('{unit}', {_now(moment)})"
    return f'"timestamp" < {start} and "timestamp" >= {start} - interval 1 {unit}'


def _trailing(length, moment):
    return f"\"timestamp\" >= date_trunc('minute', {_now(moment)}) - interval {length}"


PRESETS = {
    "hour": lambda m: _since("hour", m),
    "today": lambda m: _since("day", m),
    "month_to_date": lambda m: _since("month", m),
    "year_to_date": lambda m: _since("year", m),
    "yesterday": lambda m: _before_current("day", m),
    "last_month": lambda m: _before_current("month", m),
    "last_year": lambda m: _before_current("year", m),
    "past_hour": lambda m: _trailing("1 hour", m),
    "past_7_days": lambda m: _trailing("7 day", m),
    "past_14_days": lambda m: _trailing("14 day", m),
    "past_30_days": lambda m: _trailing("30 day", m),
    "all_time": lambda m: "true",
}
# clocks at which every preset is checked
CLOCKS = {"": AS_OF, "_february": LATER, "_next_year": NEXT_YEAR}
for _suffix, _clock in CLOCKS.items():
    for _name, _condition in PRESETS.items():
        if _suffix and _name == "all_time":
            continue
        spec_query(f"interval_{_name}{_suffix}", QuerySpec(interval=_name, as_of=_clock), _condition(_clock))

# site scope
_VISIBLE = f"select service_id from ({fx.sql(fx.SERVICES)}) where published"


def _services(s, d):
    return fx.registry(s, d).services


QUERIES["scope_published"] = lambda s, d: reports.scope(
    fx.page_views(s, d), reports.visible_services(_services(s, d))
).select("event_id", "service_id")
views("scope_published", f"service_id in ({_VISIBLE})", "event_id, service_id")

_SOME = [f"svc-{n}" for n in range(0, 40)]
_FEW = ["svc-0", "svc-4", "svc-5", "svc-77"]
_IN_SOME, _IN_FEW = (f"service_id in ({', '.join(repr(v) for v in group)})" for group in (_SOME, _FEW))


def _scope_requested(s, d):
    sites = reports.visible_services(_services(s, d), permitted=_SOME, requested=_FEW)
    return reports.scope(fx.page_views(s, d), sites).select("event_id", "service_id")


QUERIES["scope_permitted_and_requested"] = _scope_requested
views(
    "scope_permitted_and_requested",
    f"service_id in ({_VISIBLE} and {_IN_SOME} and {_IN_FEW})",
    "event_id, service_id",
)


def _scope_frame(s, d):
    permitted = fx.frame(s, d, fx.SERVICE_MATCHERS).select("service_id").distinct()
    return reports.scope(fx.page_views(s, d), reports.visible_services(_services(s, d), permitted)).select(
        "event_id", "service_id"
    )


QUERIES["scope_permitted_table"] = _scope_frame
views(
    "scope_permitted_table",
    f"service_id in ({_VISIBLE}) and service_id in (select service_id from ({fx.sql(fx.SERVICE_MATCHERS)}))",
    "event_id, service_id",
)


def _scope_empty(s, d):
    nobody = fx.frame(s, d, fx.SERVICES).where(F.length("service_id") < 0).select("service_id")
    sites = reports.visible_services(_services(s, d), permitted=nobody)
    return reports.scope(fx.page_views(s, d), sites).agg(F.count("*").alias("count"))


QUERIES["scope_nothing_permitted"] = _scope_empty
views("scope_nothing_permitted", "false", 'count(*) as "count"')
