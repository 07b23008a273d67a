"""Panels, counts and series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from pagetally.functions import labels
from pagetally.model import DIMENSIONS, GROUPING_IDS, UNKNOWN_LABEL
from pagetally.operators import panels, series
from pagetally.plans import reports
from pagetally.plans.spec import QuerySpec

QUERIES, SQL = {}, {}

WA = f"with web_analytics as ({fx.sql(fx.WEB_ANALYTICS)})"
_COLUMNS = ", ".join(DIMENSIONS)
_CASE = " ".join(f"when {GROUPING_IDS[d]} then {d}" for d in DIMENSIONS)

# the report as one grouping-sets statement
COUNTS = f"""
select cast(grouping({_COLUMNS}) as integer) as grouping_id, case grouping({_COLUMNS}) {_CASE} end as value,
  count(*) as "count"
from web_analytics group by grouping sets ({", ".join(f"({d})" for d in DIMENSIONS)})"""
FULL = f"""
select *, max("count") over (partition by grouping_id) as "max",
  row_number() over (partition by grouping_id order by "count" desc, value asc nulls first) as position
from ({COUNTS})"""


def top(limit):
    return f'select grouping_id, value, "count", "max" from ({FULL}) where position <= {limit}'


QUERIES["panel_counts"] = lambda s, d: panels.panel_counts(fx.page_views(s, d))
SQL["panel_counts"] = f"{WA} {COUNTS}"

QUERIES["panel_counts_grouping_sets"] = lambda s, d: panels.panel_counts(fx.page_views(s, d), "grouping_sets")
SQL["panel_counts_grouping_sets"] = SQL["panel_counts"]

QUERIES["panel_top300"] = lambda s, d: panels.panel(fx.page_views(s, d))
SQL["panel_top300"] = f"{WA} {top(300)}"

QUERIES["panel_top300_grouping_sets"] = lambda s, d: panels.panel(fx.page_views(s, d), form="grouping_sets")
SQL["panel_top300_grouping_sets"] = SQL["panel_top300"]

QUERIES["panel_top10"] = lambda s, d: panels.panel(fx.page_views(s, d), 10)
SQL["panel_top10"] = f"{WA} {top(10)}"

for _limit in (10, 300):
    QUERIES[f"panel_top{_limit}_threshold"] = lambda s, d, n=_limit: panels.panel(fx.page_views(s, d), n, selection="threshold")
    SQL[f"panel_top{_limit}_threshold"] = f"{WA} {top(_limit)}"

QUERIES["panel_all_values"] = lambda s, d: panels.panel(fx.page_views(s, d), None)
SQL["panel_all_values"] = f'{WA} select grouping_id, value, "count", "max" from ({FULL})'


def _panel_order(s, d):
    """Position of every row in the order the panel defines."""
    rows = panels.panel_counts(fx.page_views(s, d))
    ranked = panels.top_values(rows, 300)
    order = Window.partitionBy("grouping_id").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return ranked.withColumn("position", F.row_number().over(order))


QUERIES["panel_order"] = _panel_order
SQL["panel_order"] = f'{WA} select grouping_id, value, "count", cast(position as integer) as position from ({FULL}) where position <= 300'

for _name in DIMENSIONS:
    QUERIES[f"panel_of_{_name}"] = lambda s, d, name=_name: panels.panel_of(
        panels.panel(fx.page_views(s, d), dimensions=(name,)), name
    )
    SQL[f"panel_of_{_name}"] = f"""{WA} select * from (
      select {_name} as value, count(*) as "count", max(count(*)) over () as "max"
      from web_analytics group by {_name}) order by "count" desc, value asc nulls first limit 300"""

_PRESENT = f"""case when coalesce(value, '') = '' then '{UNKNOWN_LABEL}'
  when grouping_id = {GROUPING_IDS["country_code"]} then coalesce(t.name, value) else value end"""

QUERIES["panel_labels"] = lambda s, d: panels.present(panels.panel(fx.page_views(s, d)), fx.territories(s))
SQL["panel_labels"] = f"""{WA} select grouping_id, value, "count", "max", {_PRESENT} as present
  from ({top(300)}) left join ({fx.TERRITORIES}) t on value = t.country_code"""


def _referrer_labels(s, d):
    rows = fx.beacons(s, d).select(F.col("r").alias("value")).distinct()
    return rows.select("value", labels.present(F.lit(GROUPING_IDS["referrer"]), F.col("value")).alias("present"))


QUERIES["label_referrers"] = _referrer_labels
SQL["label_referrers"] = f"""with b as (select distinct r as value from ({fx.sql(fx.BEACONS)}))
  select value, case when coalesce(value, '') = '' then '{UNKNOWN_LABEL}'
    when value like '%://%' or value like '//%' then
      split_part(split_part(regexp_replace(split_part(regexp_replace(value, '^.*//', ''), '/', 1), '^[^@]*@', ''), ':', 1), '?', 1)
    when regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*:') then value
    when split_part(split_part(value, '?', 1), '#', 1) = '' then '{UNKNOWN_LABEL}'
    else split_part(split_part(value, '?', 1), '#', 1) end as present from b"""

SPEC = QuerySpec(
    filters={"country_codes": ["", "EN", "FR"], "browsers": ["Chrome", "Safari", ""]},
    from_="2024-01-03",
    to="2024-01-25",
)


def _dashboard(s, d):
    sites = reports.visible_services(fx.registry(s, d).services)
    return reports.report(fx.page_views(s, d), SPEC, sites, fx.territories(s), 50)


QUERIES["dashboard_report"] = _dashboard
SQL["dashboard_report"] = f"""with all_views as ({fx.sql(fx.WEB_ANALYTICS)}),
  web_analytics as (select * from all_views
    where service_id in (select service_id from ({fx.sql(fx.SERVICES)}) where published)
      and (country_code in ('EN', 'FR') or country_code is null)
      and (browser in ('Chrome', 'Safari') or browser is null)
      and "timestamp" >= timestamp '2024-01-03 00:00:00' and "timestamp" <= timestamp '2024-01-25 23:59:59')
  select grouping_id, value, "count", "max", {_PRESENT} as present
  from ({top(50)}) left join ({fx.TERRITORIES}) t on value = t.country_code"""

# totals and series
TRACKED = f"with tracked as ({fx.sql(fx.TRACKED_EVENTS)})"

QUERIES["count_all"] = lambda s, d: series.count_events(fx.tracked_events(s, d))
SQL["count_all"] = f'{TRACKED} select count(*) as "count" from tracked'

QUERIES["count_between"] = lambda s, d: series.count_events(fx.tracked_events(s, d), "2024-01-05", "2024-01-09")
SQL["count_between"] = f"""{TRACKED} select count(*) as "count" from tracked
  where "timestamp" >= '2024-01-05 00:00:00'::TIMESTAMP_S and "timestamp" <= '2024-01-09 23:59:59'::TIMESTAMP_S"""

for _name in DIMENSIONS:
    QUERIES[f"count_by_{_name}"] = lambda s, d, name=_name: series.count_by(fx.page_views(s, d), name)
    SQL[f"count_by_{_name}"] = f"""{WA} select {_name} as value, count({_name}) as "count"
      from web_analytics group by {_name} order by 2 desc"""

for _name in ("hour", "day", "week", "month", "year"):
    QUERIES[f"scale_{_name}"] = lambda s, d, unit=_name: series.scale(fx.tracked_events(s, d), unit)
    SQL[f"scale_{_name}"] = f"""{TRACKED} select date_trunc('{_name}', "timestamp")::timestamp as period,
      count(*) as "count" from tracked group by 1 order by 1"""


def _value_keys(s, d):
    """Keys per dimension: as many as distinct values, with '' and NULL taken as one."""
    counts = panels.panel_counts(fx.page_views(s, d))
    keyed = counts.withColumn("key", labels.value_key(F.col("grouping_id"), F.col("value")))
    return keyed.groupBy("grouping_id").agg(F.countDistinct("key").alias("n_keys"), F.sum("count").alias("n_views"))


QUERIES["value_keys"] = _value_keys
SQL["value_keys"] = f"""{WA} select grouping_id, count(distinct coalesce(nullif(value, ''), '<null>')) as n_keys,
  cast(sum("count") as bigint) as n_views from ({COUNTS}) group by grouping_id"""
