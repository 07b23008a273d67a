"""Services, matchers and declarative files."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from pagetally.operators import registry as reg
from pagetally.sources import config_files

QUERIES, SQL = {}, {}

SV = f"with services as ({fx.sql(fx.SERVICES)}), matchers as ({fx.sql(fx.SERVICE_MATCHERS)})"


def _services(s, d):
    return fx.registry(s, d).services


QUERIES["registry_services"] = _services
SQL["registry_services"] = f"{SV} select * from services"

QUERIES["registry_matchers"] = lambda s, d: fx.registry(s, d).matchers
SQL["registry_matchers"] = f"{SV} select * from matchers"

QUERIES["services_published"] = lambda s, d: reg.published(_services(s, d))
SQL["services_published"] = f"{SV} select * from services where published"

QUERIES["services_by_ids"] = lambda s, d: reg.select_services(_services(s, d), ids=["svc-1", "svc-3", "svc-9"], shared=True)
SQL["services_by_ids"] = f"{SV} select * from services where service_id in ('svc-1', 'svc-3', 'svc-9') and published"

QUERIES["services_no_id_filter"] = lambda s, d: reg.select_services(_services(s, d), ids=[])
SQL["services_no_id_filter"] = f"{SV} select * from services"

QUERIES["services_by_name"] = lambda s, d: reg.select_services(_services(s, d), name="Supplier#000000003")
SQL["services_by_name"] = f"{SV} select * from services where name = 'Supplier#000000003'"

QUERIES["services_with_matchers"] = lambda s, d: reg.with_matchers(fx.registry(s, d))
SQL["services_with_matchers"] = f"""{SV} select service_id, name, published, matcher_id, "type", value
  from services left join matchers using (service_id)"""


QUERIES["services_matcher_counts"] = lambda s, d: reg.matcher_counts(fx.registry(s, d))
SQL["services_matcher_counts"] = f"""{SV} select service_id, count(matcher_id) as n
  from services left join matchers using (service_id) group by service_id"""


def _names(s, d):
    """Customer names are new, supplier names are taken, some by hidden sites."""
    names = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"))
    return names.unionByName(_services(s, d).select("name"))


QUERIES["services_insert_absent"] = lambda s, d: reg.insert_absent(_names(s, d), _services(s, d))
SQL["services_insert_absent"] = f"""{SV}, n as (select c_name as name from customer union all select name from services)
  select name from n where name not in (select name from services)"""

QUERIES["services_name_conflicts"] = lambda s, d: reg.name_conflicts(_names(s, d), _services(s, d))
SQL["services_name_conflicts"] = f"{SV} select name from services where not published"

_LABEL = reg.LABEL_PATTERN
_ESCAPED = r"regexp_replace(value, '([.^$*+?()\[\]{}|\\])', '\\\1', 'g')"

# a regular expression cannot start with a repetition; such matchers get no pattern
_USABLE = "case when value not like '*%' then value end"

QUERIES["matcher_patterns"] = lambda s, d: reg.compile_matchers(fx.registry(s, d).matchers)
SQL["matcher_patterns"] = f"""{SV} select *, case "type" when 'regex' then {_USABLE} when 'exact' then {_ESCAPED}
  else '^' || replace(value, '*', '{_LABEL}') || '$' end as pattern from matchers"""

QUERIES["matcher_patterns_strict"] = lambda s, d: reg.compile_matchers(fx.registry(s, d).matchers, "strict")
SQL["matcher_patterns_strict"] = f"""{SV} select *, case "type" when 'regex' then {_USABLE}
  when 'exact' then '^' || {_ESCAPED} || '$'
  else '^' || replace({_ESCAPED}, '\\*', '{_LABEL}') || '$' end as pattern from matchers"""

# A file per supplier; some of them have an override, an unknown matcher type,
# no name or no service section.
_FILES = """
select concat('site-', cast(s_suppkey as varchar(20)), '.conf') as file, 0 as layer,
  concat(case when s_nationkey = 3 then '[Other]' else '[Service]' end, chr(10),
    case when s_nationkey = 4 then 'Title=x' else concat('Name = ', s_name) end, chr(10),
    case when s_nationkey % 3 = 0 then concat('published=yes', chr(10)) when s_nationkey % 3 = 1 then concat('published=no', chr(10)) else '' end,
    '; a comment = with a sign', chr(10), chr(10),
    '[Matcher]', chr(10), 'Type=exact', chr(10), 'Value=', 'host-', cast(s_suppkey as varchar(20)), '.example', chr(10),
    '[Matcher]', chr(10), 'type=', case when s_nationkey = 5 then 'glob' else 'wildcard' end, chr(10), 'value=*.example.com', chr(10)) as content
from {supplier}
union all
select concat('site-', cast(s_suppkey as varchar(20)), '.conf') as file, 1 as layer,
  concat('[Service]', chr(10), 'Name=', s_name, ' override', chr(10), 'published=1', chr(10)) as content
from {supplier} where s_nationkey = 6"""


def _parsed(s, d):
    return config_files.parse_config_files(fx.frame(s, d, _FILES))


QUERIES["config_services"] = lambda s, d: _parsed(s, d)[0]
SQL["config_services"] = """select concat('site-', s_suppkey::varchar, '.conf') as file,
  case when s_nationkey = 6 then s_name || ' override' else s_name end as name,
  s_nationkey % 3 <> 1 as published from supplier where s_nationkey not in (3, 4)"""

QUERIES["config_matchers"] = lambda s, d: _parsed(s, d)[1]
SQL["config_matchers"] = """select concat('site-', s_suppkey::varchar, '.conf') as file, 2 as matcher_no, 'exact' as "type",
    concat('host-', s_suppkey::varchar, '.example') as value from supplier where s_nationkey not in (3, 4, 6)
  union all
  select concat('site-', s_suppkey::varchar, '.conf'), 3, 'wildcard', '*.example.com' from supplier
  where s_nationkey not in (3, 4, 5, 6)"""

QUERIES["config_errors"] = lambda s, d: _parsed(s, d)[2]
SQL["config_errors"] = """select concat('site-', s_suppkey::varchar, '.conf') as file, 
  case s_nationkey when 3 then 'missing service section' when 4 then 'missing name' else 'invalid matcher' end as error
  from supplier where s_nationkey in (3, 4, 5)"""

QUERIES["config_override"] = lambda s, d: config_files.override(fx.frame(s, d, _FILES))
SQL["config_override"] = f"""with f as ({fx.sql(_FILES)})
  select * from f where layer = (select max(layer) from f g where g.file = f.file)"""


def _registered(s, d):
    """Declared services against a registry that has every second supplier already."""
    services, matchers, _ = _parsed(s, d)
    current = _services(s, d).where(F.substring("name", -1, 1).isin("0", "2", "4", "6", "8"))
    return reg.register_new(services, matchers, current)


_UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_NEW = f"""with declared as ({SQL["config_services"]}), new as (
  select {_UUID.format("'service/' || name")} as service_id, * from declared
  where name like '%override' or right(name, 1) not in ('0', '2', '4', '6', '8')),
  m as ({SQL["config_matchers"]})"""

QUERIES["config_new_services"] = lambda s, d: _registered(s, d).services
SQL["config_new_services"] = f"{_NEW} select service_id, name, published from new"

QUERIES["config_new_matchers"] = lambda s, d: _registered(s, d).matchers
SQL["config_new_matchers"] = f"""{_NEW} select {_UUID.format("'matcher/' || service_id || '/' || value")} as matcher_id, service_id, "type", value
  from new join m using (file)"""
