"""Scalar functions on whole tables."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from pagetally.functions import clock, uri
from pagetally.sources import synthetic

QUERIES, SQL = {}, {}


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


_UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _truncated(s, d):
    return _events(s, d).select("event_id", *[clock.trunc_column(u, F.col("ts")).alias(f"ts_{u}") for u in _UNITS])


QUERIES["fn_date_trunc"] = _truncated
SQL["fn_date_trunc"] = (
    "select event_id, "
    + ", ".join(f"date_trunc('{u}', ts)::timestamp as ts_{u}" for u in _UNITS)
    + " from events"
)


def _intervals(s, d):
    shifts = {"hour": 1, "day": 7, "month": 1, "year": -1}
    return _events(s, d).select(
        "event_id", *[(F.col("ts") + clock.interval_literal(n, u)).alias(f"plus_{u}") for u, n in shifts.items()]
    )


QUERIES["fn_interval"] = _intervals
SQL["fn_interval"] = """select event_id, ts + interval 1 hour as plus_hour, ts + interval 7 day as plus_day,
  ts + interval 1 month as plus_month, ts - interval 1 year as plus_year from events"""

QUERIES["fn_period_label"] = lambda s, d: _events(s, d).select("event_id", clock.period_label(F.col("ts")).alias("label"))
SQL["fn_period_label"] = "select event_id, strftime(ts, '%Y-%m-%d %H:%M') as label from events"


def _checks(s, d):
    visits = fx.beacons(s, d)
    seconds = F.unix_timestamp(F.col("received_at").cast("timestamp")) - F.lit(600_000_000) * (F.col("beacon_id") % 2)
    return visits.select(
        "beacon_id",
        clock.is_valid_unix_time(seconds).alias("time_ok"),
        uri.is_absolute(F.col("r")).alias("uri_ok"),
    )


QUERIES["fn_validity"] = _checks
SQL["fn_validity"] = f"""select beacon_id,
  epoch(date_trunc('second', received_at)) - 600000000 * (beacon_id % 2) between 1105829760 and 253402300799 as time_ok,
  case when r is not null then regexp_matches(r, '^[a-z-]+://[^/?#]') end as uri_ok
  from ({fx.sql(fx.BEACONS)})"""


def _strip_www(s, d):
    host = uri.host(F.col("url"))
    return s.read.parquet(f"{d}/pages.parquet").select(
        "page_id", host.alias("host"), uri.strip_www(F.concat(F.lit("www."), host)).alias("bare")
    )


QUERIES["fn_strip_www"] = _strip_www
SQL["fn_strip_www"] = """with h as (select page_id, split_part(split_part(url, '/', 3), '?', 1) as host from pages)
  select page_id, host, case when host like 'www.%' then substr(host, 5) else host end as bare from h"""


def _local(s, d):
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    names = ["localhost", "app.localhost", "127.0.0.1", "10.1.2.3", "172.20.0.1", "172.40.0.1", "192.168.7.7", "0.0.0.0",
             "localhost.example.org", "110.1.2.3"]
    host = F.element_at(F.array(*[F.lit(n) for n in names]), number % 10 + 1)
    return _events(s, d).select("event_id", host.alias("host")).where(~uri.is_local_host(F.col("host")))


QUERIES["fn_not_local_host"] = _local
SQL["fn_not_local_host"] = """with h as (select event_id, (['localhost', 'app.localhost', '127.0.0.1', '10.1.2.3', '172.20.0.1', '172.40.0.1',
    '192.168.7.7', '0.0.0.0', 'localhost.example.org', '110.1.2.3'])[cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10 + 1] as host
    from events)
  select * from h where host in ('172.40.0.1', 'localhost.example.org', '110.1.2.3')"""


def _synthetic(s, d):
    rows = _events(s, d).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("svc-"), F.col("user_id").cast("string")).alias("service_id"),
        F.col("ts").alias("timestamp"),
    )
    return synthetic.synth_page_views(rows, seed=42)


def _synthetic_sql():
    def draw(stream, size):
        digest = f"md5('42:{stream}:' || cast(event_id as varchar))"
        return f"(cast('0x' || substr({digest}, 1, 13) as bigint) % {size})"

    def pick(values, at):
        items = ", ".join("null" if v is None else f"'{v}'" for v in values)
        return f"([{items}])[{at} + 1]"

    hosts = [v and v.split("/")[2] for v in synthetic.REFERRERS]
    agent = draw(2, len(synthetic.AGENTS))
    campaign = draw(1, len(synthetic.CAMPAIGNS))
    utm = ", ".join(
        f"{pick([c[i] for c in synthetic.CAMPAIGNS], campaign)} as {name}"
        for i, name in enumerate(("utm_source", "utm_medium", "utm_campaign", "utm_content"))
    )
    sections = len(synthetic.SECTIONS)
    return f"""with e as (select *, {draw(4, synthetic.ROOT_WEIGHT + sections * synthetic.PAGES_PER_SECTION)} - {synthetic.ROOT_WEIGHT} as slot from events)
    select event_id as id, concat('svc-', user_id::varchar) as service_id, ts as "timestamp",
      concat('svc-', user_id::varchar, '.example.com') as namespace,
      case when slot < 0 then '/' else concat('/', {pick(synthetic.SECTIONS, f"(((slot % {sections}) + {sections}) % {sections})")}, '/', (slot // {sections})::varchar) end as path,
      {pick(hosts, draw(3, len(hosts)))} as referrer, null::varchar as referrer_source, {utm}, null::varchar as country_code,
      {pick(["Windows", "Windows", "macOS", "iOS", "Android"], agent)} as operating_system,
      {pick(["10.0", "10.0", "10.15.7", "17.5", "14"], agent)} as operating_system_version,
      {pick(["Chrome", "Firefox", "Safari", "Safari", "Chrome"], agent)} as browser,
      {pick(["131.0.0.0", "133.0", "17.4", "17.5", "130.0.0.0"], agent)} as browser_version
    from e"""


QUERIES["synthetic_page_views"] = _synthetic
SQL["synthetic_page_views"] = _synthetic_sql()
