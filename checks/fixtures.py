"""Inputs of the registered queries, derived from the given tables.

Each text runs unchanged in Spark and in DuckDB (``{events}`` and the like are
table names), so both sides of a check start from the same rows.

* One third of the users share the site ``svc-0``: a hot key on purpose.
* User ids reach beyond the supplier keys, so some beacons name unknown sites.
* Sites without matchers, unpublished sites, NULLs, empty strings and equal
  counts all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetally.operators.lookups import Lookups
from pagetally.operators.registry import Registry

_SITE = "case when e.user_id % 3 = 0 then 'svc-0' else concat('svc-', cast(e.user_id as varchar(20))) end"
_INSTANCE = "case when e.user_id % 4 = 1 then 'acme' else 'main' end"

_VISITS = """
  (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
     event_id % (select count(*) from {pages}) as page_no from {events} WHERE) e
  join {pages} p on e.page_no = p.page_id"""

_DIMENSIONS = """
  regexp_extract(p.url, '^https?://([^/?#]+)', 1) as namespace,
  regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1) as path,
  case when k % 4 = 0 then null else concat('ref', cast(k % 7 as varchar(20)), '.example.net') end as referrer,
  case when k % 4 = 0 then null when k % 7 < 3 then concat('Source', cast(k % 7 as varchar(20))) else null end as referrer_source,
  case when p.url like '%utm_source=%' then 'rss' else null end as utm_medium,
  nullif(regexp_extract(p.url, '[?&]utm_source=([^&#]*)', 1), '') as utm_source,
  case when k % 10 = 0 then 'spring' when k % 10 = 1 then '' else null end as utm_campaign,
  case when k % 9 = 0 then 'cta' else null end as utm_content,
  case when k % 6 = 0 then null else upper(regexp_extract(p.url, '^https?://[^/]+/([a-z][a-z])/', 1)) end as country_code,
  case k % 3 when 0 then 'macOS' when 1 then 'Windows' else null end as operating_system,
  case k % 3 when 0 then '10.15' when 1 then cast(10 + k % 2 as varchar(20)) else null end as operating_system_version,
  case k % 5 when 0 then 'Chrome' when 1 then 'Safari' when 2 then 'Firefox' when 3 then 'Microsoft Edge' else null end as browser,
  case k % 5 when 4 then null else concat(cast(100 + k % 8 as varchar(20)), '.0') end as browser_version"""

# every event with its type; the stored table
TRACKED_EVENTS = f"""
select e.event_id, {_INSTANCE} as instance, {_SITE} as entity_id, e.ts as timestamp,
  case when e.event_type = 'view' then 'pageview' else e.event_type end as type, {_DIMENSIONS}
from {_VISITS.replace("WHERE", "")}"""

# the page-view view
WEB_ANALYTICS = f"""
select e.event_id, {_SITE} as service_id, e.ts as timestamp, {_DIMENSIONS}
from {_VISITS.replace("WHERE", "where event_type = 'view'")}"""

# raw beacons with every reason for a reject
BEACONS = f"""
select e.event_id as beacon_id, {_INSTANCE} as instance, e.ts as received_at,
  case when k = 97 then null
       when k % 5 = 0 then 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2.1 Safari/605.1.15'
       when k % 5 = 1 then 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
       when k % 5 = 2 then 'Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0'
       when k % 5 = 3 then 'Mozilla/5.0 (Linux; Android 13; Pixel 7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Mobile Safari/537.36'
       when k % 10 = 9 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'
       else 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' end as user_agent,
  case when k = 99 then '150' when k = 98 then '1' when k = 94 then 'true' when k = 93 then 'yes'
       when k % 3 = 0 then 'false' when k % 3 = 1 then '' else '0' end as b,
  case when k = 95 then '?only=query'
       when k % 4 = 0 then p.url
       when k % 4 = 1 then regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1)
       when k % 4 = 2 then regexp_extract(p.url, '^https?://[^/?#]+/([^?#]*)', 1)
       else concat(regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1), '?x=1#y') end as p,
  case k % 7 when 0 then '?utm_source=a+b&utm_medium=x%20y' when 1 then 'utm_source=one&utm_source=two'
             when 2 then '?utm_campaign=%zz&utm%5Fcontent=box' when 3 then '?utm_content=a=b&utm_medium'
             when 4 then '' when 5 then '??page=2&utm_source=caf%C3%A9&&utm_source=' else null end as q,
  case k % 11 when 0 then 'https://www.google.com/search?q=1' when 1 then 'news.ycombinator.com' when 2 then ''
              when 3 then 'android-app://com.google.android.gm' when 4 then 'https://t.co/abc' when 5 then 'mailto:x@y'
              when 6 then 'http://user:pw@News.example.net:8080/a?b#c' when 7 then 'https://mail.google.com/'
              when 8 then '//cdn.example.net/x' when 9 then '?q=only' else null end as r,
  case when k = 96 then null when k = 92 then 'about:blank'
       else regexp_extract(p.url, '^(https?://[^/?#]+)', 1) end as o,
  {_SITE} as i,
  case k % 4 when 0 then 'Europe/Paris' when 1 then 'America/New_York' when 2 then 'Not/AZone' else null end as z
from {_VISITS.replace("WHERE", "")}"""

# one site per supplier
SERVICES = """
select concat('svc-', cast(s_suppkey as varchar(20))) as service_id, s_name as name, s_acctbal >= 0 as published
from {supplier}"""

# twenty customers make the matchers of one site; the last sites get none
SERVICE_MATCHERS = """
select concat('m', cast(c_custkey as varchar(20))) as matcher_id,
  concat('svc-', cast(cast(floor(c_custkey / 20) as bigint) as varchar(20))) as service_id,
  case c_custkey % 3 when 0 then 'wildcard' when 1 then 'exact' else 'regex' end as type,
  case when c_custkey % 20 = 0 and c_nationkey % 4 = 0 then '*.*.example.com'
       when c_custkey % 20 = 1 and c_nationkey % 4 = 1 then '*.*.*.example.com'
       when c_custkey % 20 = 2 and c_nationkey % 3 = 0 then '^(www|m)[.]'
       when c_custkey % 20 = 3 and c_nationkey % 2 = 0 then 'example.org'
       when c_custkey % 20 = 4 and c_nationkey % 2 = 0 then 'example.net'
       when c_custkey % 3 = 0 then concat('*.site-', cast(c_custkey as varchar(20)), '.example')
       when c_custkey % 3 = 1 then concat('host-', cast(c_custkey as varchar(20)), '.example')
       else concat('^site-', cast(c_custkey as varchar(20)), '[.]') end as value
from {customer}"""

# every event's user agent, with a system per nation, one of many applications, some robots
SEEN_AGENTS = """
select e.event_id as beacon_id, case when e.event_id % 50 = 49 then null else
  concat('Mozilla/5.0 (X; OS-', n.n_name, ' ', cast(e.event_id % 20 as varchar(20)), '_', cast(e.event_id % 3 as varchar(20)),
    ') App', cast(e.event_id % 2377 as varchar(20)), '/', cast(e.event_id % 10 as varchar(20)), '.', cast(e.event_id % 4 as varchar(20)),
    case when e.user_id % 9 = 0 then concat(' FETCH-', cast(e.user_id as varchar(20)), '-x') else '' end) end as user_agent
from {events} e join {nation} n on e.user_id % 25 = n.n_nationkey"""

# a browser rule per part, one for the rest and one before all others; a system per nation; a robot per supplier
AGENT_RULES = """
select 'browser' as kind, cast(p_partkey as int) as "position", concat('App', cast(p_partkey as varchar(20)), '/') as literal,
  cast(null as varchar(20)) as pattern, p_brand as family, concat('App', cast(p_partkey as varchar(20)), '/([0-9.]+)') as version from {part}
union all select 'browser', 100000000, null, 'App[0-9]+/', 'Some App', '/([0-9])[.][0-9]*$'
union all select 'browser', -1, 'App77', null, 'First', null
union all select 'system', cast(n_nationkey as int), concat('OS-', n_name, ' '), null, n_name, 'OS-[A-Z0-9_]+ ([0-9_]+)' from {nation}
union all select 'bot', cast(s_suppkey as int), null, concat('(?i)fetch-', cast(s_suppkey as varchar(20)), '-'), s_name, null from {supplier}
union all select 'bot', 0, null, '(broken', 'never', null"""

# every event's page as a referrer, and rules for some hosts, domains and paths
SEEN_REFERRERS = f"""
select e.event_id as beacon_id, p.url as r from {_VISITS.replace("WHERE", "")}"""
PATH_RULES = """
select case page_id % 3 when 0 then concat(regexp_extract(url, '^https?://([^/?#]+)', 1), regexp_extract(url, '^https?://[^/?#]+(/[a-z]+)', 1))
    when 1 then concat(regexp_extract(url, '^https?://([^/?#]+)', 1), regexp_extract(url, '^https?://[^/?#]+(/[a-z]+/[0-9]+)', 1), '/')
    else regexp_extract(url, '^https?://([^/?#]+)', 1) end as host,
  concat('rule ', cast(min(page_id) as varchar(20))) as source from {pages} group by 1
union all select 'example.com/en', 'english' union all select 'example.net', 'net' union all select 'example.org/e', 'no whole segment'"""

# small lookup tables joined to the derived data
SPAM_HOSTS = "select * from (values ('spam-farm.example.org'), ('www.cheap-pills.example.com')) as t(host)"
ZONES = """select * from (values ('Europe/Paris', 'FR'), ('America/New_York', 'US'),
  ('Asia/Tokyo', 'JP')) as t(zone, country_code)"""
SOURCES = """select * from (values ('google.com', 'Google'), ('mail.google.com', 'Gmail'), ('t.co', 'Twitter'),
  ('example.net', 'Example'), ('google.android.gm', 'Android Mail')) as t(host, source)"""
TERRITORIES = """select * from (values ('FR', 'France'), ('DE', 'Germany'), ('ES', 'Spain'),
  ('US', 'United States')) as t(country_code, name)"""

TABLES = ("events", "pages", "supplier", "customer", "part", "nation")


def frame(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """A fixture in Spark; ``given`` frames take the place of tables."""
    used = [name for name in TABLES if "{" + name + "}" in text and name not in given]
    text = text.replace('"position"', "`position`")
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used}
    return spark.sql(text, **frames, **given)


def sql(text: str) -> str:
    """A fixture for DuckDB."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, TRACKED_EVENTS)


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, WEB_ANALYTICS)


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, BEACONS)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files.

    The path is a pattern because a stream takes a single file only that way; it
    also takes a folder of files.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def beacon_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons derived from the event stream."""
    return frame(spark, sf_dir, BEACONS, events=event_stream(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(frame(spark, sf_dir, SERVICES), frame(spark, sf_dir, SERVICE_MATCHERS))


def lookups(spark: SparkSession) -> Lookups:
    return Lookups(spark.sql(SPAM_HOSTS), spark.sql(ZONES), spark.sql(SOURCES))


def territories(spark: SparkSession) -> DataFrame:
    return spark.sql(TERRITORIES)
