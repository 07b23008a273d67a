"""Batch ingest: one query per derived column and the whole result."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from pagetally.functions import agents, uri
from pagetally.model import DIMENSIONS
from pagetally.operators import agents as agent_rules
from pagetally.operators import ingest as ing
from pagetally.operators import lookups as lk

QUERIES, SQL = {}, {}

B = f"with beacons as ({fx.sql(fx.BEACONS)})"

# building blocks of the SQL side, one common table expression per step
AGENTS_SQL = """case when user_agent like '%Firefox/%' then 'Firefox' when user_agent like '%Chrome/%' then 'Chrome'
    when user_agent like '%Safari/%' then 'Safari' end as browser,
  case when user_agent like '%Firefox/%' then regexp_extract(user_agent, 'Firefox/([0-9.]*[0-9])', 1)
    when user_agent like '%Chrome/%' then regexp_extract(user_agent, 'Chrome/([0-9.]*[0-9])', 1)
    when user_agent like '%Safari/%' then regexp_extract(user_agent, 'Version/([0-9.]*[0-9])', 1) end as browser_version,
  case when user_agent like '%Windows%' then 'Windows' when user_agent like '%iPhone%' then 'iOS'
    when user_agent like '%Macintosh%' then 'macOS' when user_agent like '%Android%' then 'Android' end as operating_system,
  case when user_agent like '%Windows%' then regexp_extract(user_agent, 'Windows NT ([0-9.]+)', 1)
    when user_agent like '%iPhone%' then replace(regexp_extract(user_agent, 'iPhone OS ([0-9_]+)', 1), '_', '.')
    when user_agent like '%Macintosh%' then replace(regexp_extract(user_agent, 'Mac OS X ([0-9_]+)', 1), '_', '.')
    when user_agent like '%Android%' then regexp_extract(user_agent, 'Android ([0-9.]+)', 1) end as operating_system_version,
  coalesce(user_agent like '%bot%', false) as bot_agent"""

REST_OF_PATH = "regexp_replace(regexp_replace(p, '^https?://[^/?#]*', ''), '[?#].*$', '')"
PATH_SQL = f"""case when {REST_OF_PATH} = '' then null when {REST_OF_PATH} like '/%' then {REST_OF_PATH}
  else '/' || {REST_OF_PATH} end"""
BAD_PATH_SQL = f"coalesce(p <> '' and {REST_OF_PATH} = '', false)"

REFERRER_HOST_SQL = """nullif(case when r like '%://%' or r like '//%' then
  split_part(split_part(regexp_replace(split_part(regexp_replace(r, '^.*//', ''), '/', 1), '^[^@]*@', ''), ':', 1), '?', 1) end, '')"""
REFERRER_SQL = f"""case when r like '%://%' or r like '//%' then {REFERRER_HOST_SQL}
  when regexp_matches(r, '^[a-z-]+:') then null else nullif(split_part(r, '?', 1), '') end"""

ORIGIN_SQL = "case when o like 'http%' then regexp_replace(o, '^https?://', '') end"


def query_value_sql(key):
    """Last pair with the key; keys and values decoded, no '=' means ''."""
    pairs = "string_split(regexp_replace(q, '^[?]+', ''), '&')"
    last = f"list_filter({pairs}, lambda x: url_decode(split_part(x, '=', 1)) = '{key}')[-1]"
    return f"url_decode(case when contains({last}, '=') then substr({last}, instr({last}, '=') + 1) when {last} is not null then '' end)"


UTM_SQL = ", ".join(f"{query_value_sql(k)} as {k}" for k in ("utm_medium", "utm_source", "utm_campaign", "utm_content"))

PATTERN_SQL = r"""case "type" when 'regex' then case when value not like '*%' then value end
  when 'exact' then regexp_replace(value, '([.^$*+?()\[\]{}|\\])', '\\\1', 'g')
  else '^' || replace(value, '*', '[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?') || '$' end"""

FULL_SQL = f"""{B},
services as ({fx.sql(fx.SERVICES)}),
matchers as (select service_id, {PATTERN_SQL} as pattern from ({fx.sql(fx.SERVICE_MATCHERS)})),
cast_rows as (select *, {ORIGIN_SQL} as namespace, {PATH_SQL} as path, {BAD_PATH_SQL} as bad_path,
  {REFERRER_SQL} as referrer, {REFERRER_HOST_SQL} as referrer_host, {UTM_SQL}, {AGENTS_SQL} from beacons),
accepted_pairs as (select distinct i, namespace from cast_rows c
  where exists (select 1 from matchers m where m.service_id = c.i and regexp_matches(c.namespace, m.pattern))),
source_rules as (select referrer_host, source from (
  select h.referrer_host, s.source, row_number() over (partition by h.referrer_host order by length(s.host) desc) as n
  from (select distinct referrer_host from cast_rows) h join ({fx.SOURCES}) s
    on h.referrer_host = s.host or h.referrer_host like '%.' || s.host) where n = 1),
joined as (select c.*, s.service_id is not null as service_found, a.i is not null as host_matched, z.country_code,
    coalesce(c.namespace in (select host from ({fx.SPAM_HOSTS})), false) as is_spam_host, src.source as referrer_source
  from cast_rows c left join services s on c.i = s.service_id
  left join accepted_pairs a on c.i = a.i and c.namespace = a.namespace
  left join ({fx.ZONES}) z on c.z = z."zone"
  left join source_rules src on c.referrer_host = src.referrer_host),
ingested as (select *, i as service_id, date_trunc('second', received_at)::timestamp as "timestamp",
  case when bad_path then 'invalid_path'
    when b not in ('', '0', '1', 'true', 'false') then 'invalid_params'
    when b in ('1', 'true') then 'is_bot'
    when user_agent is null then 'missing_user_agent'
    when bot_agent then 'is_bot'
    when is_spam_host then 'spam_host'
    when namespace is null then 'no_origin'
    when not service_found then 'service_not_found'
    when not host_matched then 'no_pattern_match' end as reason
  from joined)"""

_DIMENSIONS = ", ".join(DIMENSIONS)


def _ingested(s, d, **options):
    return ing.ingest(fx.beacons(s, d), fx.registry(s, d), fx.lookups(s), **options)


# step by step
def _casts(s, d):
    return ing.cast_beacons(fx.beacons(s, d)).select(
        "beacon_id", "bot_flag", F.coalesce("invalid_params", F.lit(False)).alias("invalid_params")
    )


QUERIES["ingest_casts"] = _casts
SQL["ingest_casts"] = f"""{B} select beacon_id, case when b in ('1', 'true') then true when b in ('0', 'false') then false end as bot_flag,
  b not in ('', '0', '1', 'true', 'false') as invalid_params from beacons"""

QUERIES["ingest_bot_agents"] = lambda s, d: fx.beacons(s, d).select(
    "beacon_id", F.coalesce(agents.is_bot(F.col("user_agent")), F.lit(False)).alias("bot_agent")
)
SQL["ingest_bot_agents"] = f"{B} select beacon_id, coalesce(user_agent like '%bot%', false) as bot_agent from beacons"

_AGENT = ("browser", "browser_version", "operating_system", "operating_system_version")
QUERIES["ingest_agents"] = lambda s, d: ing.agent_columns(fx.beacons(s, d)).select("beacon_id", *_AGENT)
SQL["ingest_agents"] = f"{B}, a as (select *, {AGENTS_SQL} from beacons) select beacon_id, {', '.join(_AGENT)} from a"


def _agent_table(s, d):
    """Agents parsed once per distinct value, then joined back."""
    beacons = fx.beacons(s, d)
    table = ing.agent_columns(beacons.select("user_agent").distinct()).withColumnRenamed("bot_agent", "is_bot")
    return ing.agent_columns(beacons, table).select("beacon_id", *_AGENT, "bot_agent")


QUERIES["ingest_agent_table"] = _agent_table
SQL["ingest_agent_table"] = f"{B}, a as (select *, {AGENTS_SQL} from beacons) select beacon_id, {', '.join(_AGENT)}, bot_agent from a"

_RULED = ("user_agent", "browser", "browser_version", "operating_system", "operating_system_version", "is_bot")
QUERIES["ingest_agent_rules"] = lambda s, d: agent_rules.agent_columns(
    fx.frame(s, d, fx.SEEN_AGENTS), fx.frame(s, d, fx.AGENT_RULES)
).select("beacon_id", *_RULED[:-1], F.col("bot_agent").alias("is_bot"))
SQL["ingest_agent_rules"] = f"""with seen as ({fx.sql(fx.SEEN_AGENTS)}), rules as ({fx.sql(fx.AGENT_RULES)}),
  fired as (select a.user_agent, r.*, row_number() over (partition by a.user_agent, kind order by r.position) as n
    from (select distinct user_agent from seen where user_agent is not null) a join rules r
    on (literal is null or contains(user_agent, literal))
      and (pattern is null or case when pattern = '(broken' then false else regexp_matches(user_agent, pattern) end)),
  told as (select user_agent, kind, family, replace(nullif(regexp_extract(user_agent, version, 1), ''), '_', '.') as v from fired where n = 1)
  select beacon_id, s.user_agent, b.family as browser, b.v as browser_version, o.family as operating_system,
    o.v as operating_system_version, x.user_agent is not null as is_bot
  from seen s left join told b on s.user_agent = b.user_agent and b.kind = 'browser'
  left join told o on s.user_agent = o.user_agent and o.kind = 'system'
  left join told x on s.user_agent = x.user_agent and x.kind = 'bot'"""

QUERIES["ingest_paths"] = lambda s, d: ing.cast_beacons(fx.beacons(s, d)).select(
    "beacon_id", "path", F.coalesce("invalid_path", F.lit(False)).alias("invalid_path")
)
SQL["ingest_paths"] = f"{B} select beacon_id, {PATH_SQL} as path, {BAD_PATH_SQL} as invalid_path from beacons"


def _pairs(s, d):
    rows = fx.beacons(s, d).select("beacon_id", F.posexplode(uri.query_pairs(F.col("q"))).alias("at", "pair"))
    return rows.select("beacon_id", "at", "pair.key", "pair.value")


QUERIES["ingest_query_pairs"] = _pairs
SQL["ingest_query_pairs"] = f"""{B}, p as (select beacon_id, unnest(string_split(regexp_replace(q, '^[?]+', ''), '&')) as x,
    generate_subscripts(string_split(regexp_replace(q, '^[?]+', ''), '&'), 1) as n from beacons)
  select beacon_id, cast(n - 1 as integer) as at, url_decode(split_part(x, '=', 1)) as "key",
    url_decode(case when contains(x, '=') then substr(x, instr(x, '=') + 1) else '' end) as value from p"""

QUERIES["ingest_utm"] = lambda s, d: ing.utm_columns(ing.cast_beacons(fx.beacons(s, d))).select(
    "beacon_id", *uri.ALLOWED_QUERY_KEYS
)
SQL["ingest_utm"] = f"{B} select beacon_id, {UTM_SQL} from beacons"

QUERIES["ingest_referrers"] = lambda s, d: ing.cast_beacons(fx.beacons(s, d)).select("beacon_id", "referrer", "referrer_host")
SQL["ingest_referrers"] = f"{B} select beacon_id, {REFERRER_SQL} as referrer, {REFERRER_HOST_SQL} as referrer_host from beacons"

QUERIES["ingest_referrer_sources"] = lambda s, d: lk.with_referrer_source(
    ing.cast_beacons(fx.beacons(s, d)), F.col("referrer_host"), fx.lookups(s).sources
).select("beacon_id", "referrer_source")
SQL["ingest_referrer_sources"] = f"{FULL_SQL} select beacon_id, referrer_source from ingested"


def _referrer_paths(s, d):
    rows = fx.frame(s, d, fx.SEEN_REFERRERS)
    return lk.with_referrer_source(rows, uri.host(F.col("r")), fx.frame(s, d, fx.PATH_RULES), uri.path(F.col("r")))


QUERIES["ingest_referrer_paths"] = _referrer_paths
SQL["ingest_referrer_paths"] = f"""with seen as ({fx.sql(fx.SEEN_REFERRERS)}), given as ({fx.sql(fx.PATH_RULES)}),
  rules as (select split_part(host, '/', 1) as domain, rtrim(case when contains(host, '/') then substr(host, instr(host, '/')) else '' end, '/') as prefix,
    min(source) as source from given group by 1, 2),
  places as (select distinct r, regexp_extract(r, '^https?://([^/?#]+)', 1) as h, regexp_extract(r, '^https?://[^/?#]+([^?#]*)', 1) as path from seen),
  ranked as (select r, source, row_number() over (partition by r order by length(domain) desc, length(prefix) desc) as n from places join rules
    on (h = domain or h like '%.' || domain) and starts_with(rtrim(path, '/') || '/', prefix || '/'))
  select beacon_id, s.r, source as referrer_source from seen s left join ranked t on s.r = t.r and n = 1"""

QUERIES["ingest_origins"] = lambda s, d: ing.cast_beacons(fx.beacons(s, d)).select("beacon_id", "namespace")
SQL["ingest_origins"] = f"{B} select beacon_id, {ORIGIN_SQL} as namespace from beacons"

QUERIES["ingest_countries"] = lambda s, d: lk.with_country(fx.beacons(s, d), F.col("z"), fx.lookups(s).zones).select(
    "beacon_id", "country_code"
)
SQL["ingest_countries"] = f"{FULL_SQL} select beacon_id, country_code from ingested"

QUERIES["ingest_spam_flags"] = lambda s, d: lk.with_spam_flag(
    ing.cast_beacons(fx.beacons(s, d)), F.col("namespace"), fx.lookups(s).spam_hosts
).select("beacon_id", "is_spam_host")
SQL["ingest_spam_flags"] = f"{FULL_SQL} select beacon_id, is_spam_host from ingested"

QUERIES["ingest_without_spam"] = lambda s, d: lk.without_spam_hosts(
    ing.cast_beacons(fx.beacons(s, d)), F.col("namespace"), fx.lookups(s).spam_hosts
).select("beacon_id", "namespace")
SQL["ingest_without_spam"] = f"{FULL_SQL} select beacon_id, namespace from ingested where not is_spam_host"


def _matches(match):
    def query(s, d):
        rows = match(ing.cast_beacons(fx.beacons(s, d)), fx.registry(s, d))
        return rows.select("beacon_id", "service_found", "host_matched")

    return query


# two names from the time when small and large registries were matched differently
for _name in ("inline", "distinct"):
    QUERIES[f"ingest_site_match_{_name}"] = _matches(ing.match_sites)
    SQL[f"ingest_site_match_{_name}"] = f"{FULL_SQL} select beacon_id, service_found, host_matched from ingested"

QUERIES["ingest_matched_hosts"] = lambda s, d: ing.matched_hosts(ing.cast_beacons(fx.beacons(s, d)), fx.registry(s, d))
SQL["ingest_matched_hosts"] = f"{FULL_SQL} select i as service_id, namespace from accepted_pairs where namespace is not null"

QUERIES["ingest_matched_hosts_strict"] = lambda s, d: ing.matched_hosts(
    ing.cast_beacons(fx.beacons(s, d)), fx.registry(s, d), "strict"
)
SQL["ingest_matched_hosts_strict"] = rf"""{FULL_SQL},
  strict as (select service_id, case "type" when 'regex' then case when value not like '*%' then value end
    when 'exact' then '^' || regexp_replace(value, '([.^$*+?()\[\]{{}}|\\])', '\\\1', 'g') || '$' else '^' || replace(regexp_replace(value, '([.^$+?()\[\]{{}}|\\])', '\\\1', 'g'), '*', '[A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?') || '$' end as p
    from ({fx.sql(fx.SERVICE_MATCHERS)}))
  select distinct i as service_id, namespace from cast_rows c where namespace is not null
  and exists (select 1 from strict m where m.service_id = c.i and regexp_matches(c.namespace, m.p))"""

QUERIES["ingest_allowed_query"] = lambda s, d: fx.beacons(s, d).select("beacon_id", uri.keep_allowed(F.col("q")).alias("q"))
SQL["ingest_allowed_query"] = f"""{B}, p as (select beacon_id, q, unnest(string_split(regexp_replace(q, '^[?]+', ''), '&')) as x,
    generate_subscripts(string_split(regexp_replace(q, '^[?]+', ''), '&'), 1) as n from beacons),
  kv as (select beacon_id, n, url_decode(split_part(x, '=', 1)) as k,
    url_decode(replace(case when contains(x, '=') then substr(x, instr(x, '=') + 1) else '' end, '+', ' ')) as v from p),
  one as (select beacon_id, k, min(n) as first_n, max_by(v, n) as v from kv
    where k in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content') group by beacon_id, k),
  texts as (select beacon_id, '?' || string_agg(k || '=' || replace(url_encode(v), '%20', '+'), '&' order by first_n) as q
    from one group by beacon_id)
  select b.beacon_id, coalesce(t.q, '') as q from beacons b left join texts t using (beacon_id)"""

# the whole
QUERIES["ingest_reasons"] = lambda s, d: _ingested(s, d).select("beacon_id", "reason")
SQL["ingest_reasons"] = f"{FULL_SQL} select beacon_id, reason from ingested"

QUERIES["ingest_all_columns"] = lambda s, d: _ingested(s, d)
SQL["ingest_all_columns"] = f"""{FULL_SQL} select beacon_id, instance, received_at, user_agent, b, p, q, r, o, i, z,
  service_id, "timestamp", {_DIMENSIONS}, reason from ingested"""

QUERIES["ingest_all_columns_distinct"] = lambda s, d: _ingested(s, d)
SQL["ingest_all_columns_distinct"] = SQL["ingest_all_columns"]


def _events(s, d):
    return ing.to_events(_ingested(s, d)).select("instance", "entity_id", "timestamp", "type", "properties.*")


QUERIES["ingest_events"] = _events
SQL["ingest_events"] = f"""{FULL_SQL} select instance, service_id as entity_id, "timestamp", 'pageview' as "type",
  {", ".join(f"nullif({d}, '') as {d}" for d in DIMENSIONS)} from ingested where reason is null"""


def _rejects(s, d):
    beacons = fx.beacons(s, d)
    return ing.rejected(ing.ingest(beacons, fx.registry(s, d), fx.lookups(s)), beacons.columns)


QUERIES["ingest_rejects"] = _rejects
SQL["ingest_rejects"] = f"""{FULL_SQL} select beacon_id, instance, received_at, user_agent, b, p, q, r, o, i, z, reason
  from ingested where reason is not null"""

QUERIES["ingest_reject_counts"] = lambda s, d: ing.reject_counts(_ingested(s, d))
SQL["ingest_reject_counts"] = f"""{FULL_SQL} select reason, count(*) as "count" from ingested where reason is not null group by reason"""
