"""The stored event table, its view, beacon files and panel export."""

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.catalog.ingest import FULL_SQL
from checks.catalog.ingest import SQL as INGEST_SQL
from checks.catalog.panels import FULL, WA, top
from pagetally.functions import uri
from pagetally.model import DIMENSIONS, LAYOUTS
from pagetally.operators import ingest as ing
from pagetally.operators import panels
from pagetally.plans.spec import QuerySpec
from pagetally.session import shared_dir
from pagetally.sources import beacons as src
from pagetally.sources import export, lake

QUERIES, SQL = {}, {}

TRACKED = f"with tracked as ({fx.sql(fx.TRACKED_EVENTS)})"
_DIMENSIONS = ", ".join(DIMENSIONS)
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stored_events(s, d):
    """Fixture events in the shape ``write_events`` takes."""
    return fx.tracked_events(s, d).select(
        "instance", "entity_id", "timestamp", "type", F.struct(*DIMENSIONS).alias("properties")
    )


def stored(s, d, name, encoding="struct", layout="sorted"):
    """Write the events and give the path."""
    path = shared_dir(s, f"{name}/{uuid4().hex}/events")
    lake.write_events(stored_events(s, d), path, "all", encoding, layout)
    return path


def _scan(layout):
    def query(s, d):
        return _columns(lake.read_events(s, stored(s, d, f"scan_{layout}", layout=layout), instance=None))

    return query


def _columns(events):
    return events.select("instance", "entity_id", "timestamp", "type", "year", "month", "properties.*")


_SCAN_SQL = f"""{TRACKED} select instance, entity_id, "timestamp", "type", cast(year("timestamp") as integer) as "year",
  cast(month("timestamp") as integer) as "month", {_DIMENSIONS} from tracked"""


for _name in LAYOUTS:
    QUERIES[f"lake_event_scan_{_name}"] = _scan(_name)
    SQL[f"lake_event_scan_{_name}"] = _SCAN_SQL


def _two_batches(s, d):
    """Two appends, the second one repeated: the repeat replaces itself."""
    path = shared_dir(s, f"append/{uuid4().hex}/events")
    events = stored_events(s, d)
    views = events.where(F.col("type") == "pageview")
    others = events.where(F.col("type") != "pageview")
    lake.write_events(views, path, "views")
    lake.write_events(others, path, "others")
    lake.write_events(others, path, "others")
    read = lake.read_events(s, path, instance=None)
    return read.groupBy("batch", "instance", "type").agg(F.count("*").alias("count"))


QUERIES["lake_append_repeated"] = _two_batches
SQL["lake_append_repeated"] = f"""{TRACKED} select case when "type" = 'pageview' then 'views' else 'others' end as batch,
  instance, "type", count(*) as "count" from tracked group by all"""


def _compacted(s, d):
    root = shared_dir(s, f"compact/{uuid4().hex}")
    source, target = f"{root}/small", f"{root}/large"
    events = stored_events(s, d)
    views = F.col("type") == "pageview"
    lake.write_events(events.where(views), source, "1")
    lake.write_events(events.where(~views), source, "2")
    lake.compact(s, source, target, "1-2")
    return lake.read_events(s, target, instance=None).groupBy("batch", "entity_id").agg(F.count("*").alias("count"))


QUERIES["lake_compact"] = _compacted
SQL["lake_compact"] = f"""{TRACKED} select '1-2' as batch, entity_id, count(*) as "count" from tracked group by all"""


def _view(encoding):
    def query(s, d):
        return lake.read_page_views(s, stored(s, d, f"view_{encoding}", encoding), instance=None, encoding=encoding)

    return query


VIEW_SQL = f"""{TRACKED} select entity_id as service_id, "timestamp", {_DIMENSIONS} from tracked where "type" = 'pageview'"""
for _name in lake.ENCODINGS:
    QUERIES[f"lake_page_views_{_name}"] = _view(_name)
    SQL[f"lake_page_views_{_name}"] = VIEW_SQL


_PATHS = ("/en/471", "/fr/414", "/en/334/")


def _skipping(s, d):
    """A path filter over a table compacted to be skipped by path and referrer."""
    root = shared_dir(s, f"skipping/{uuid4().hex}")
    source, target = f"{root}/small", f"{root}/large"
    lake.write_events(stored_events(s, d), source, "1")
    lake.compact(s, source, target, "1", skip_by=["path", "referrer"])
    return lake.read_page_views(s, target, QuerySpec({"paths": list(_PATHS)}), instance=None)


QUERIES["lake_compact_skipping"] = _skipping
SQL["lake_compact_skipping"] = f"{VIEW_SQL} and ({' or '.join(f"path = '{p}'" for p in _PATHS)})"


def _properties(kind):
    """Property extraction without storage."""

    def query(s, d):
        events = stored_events(s, d)
        encoded = events.withColumn("properties", lake.encode_properties(F.col("properties"), kind))
        return lake.page_views(encoded)

    return query


for _name in ("json", "variant"):
    QUERIES[f"property_extraction_{_name}"] = _properties(_name)
    SQL[f"property_extraction_{_name}"] = VIEW_SQL

_SPEC = QuerySpec(
    filters={"services": ["svc-0", "svc-7", "svc-10"], "browsers": ["Chrome", ""]}, from_="2024-01-10", to="2024-01-20"
)


def _tenant(layout):
    return lambda s, d: lake.read_page_views(s, stored(s, d, f"tenant_{layout}", layout=layout), _SPEC, "acme")


_TENANT_SQL = f"""{TRACKED} select entity_id as service_id, "timestamp", {_DIMENSIONS} from tracked
  where "type" = 'pageview' and instance = 'acme' and entity_id in ('svc-0', 'svc-7', 'svc-10')
    and (browser = 'Chrome' or browser is null)
    and "timestamp" >= timestamp '2024-01-10 00:00:00' and "timestamp" <= timestamp '2024-01-20 23:59:59'"""

for _name in LAYOUTS:
    QUERIES[f"lake_tenant_spec_{_name}"] = _tenant(_name)
    SQL[f"lake_tenant_spec_{_name}"] = _TENANT_SQL

QUERIES["lake_panel"] = lambda s, d: panels.panel(lake.read_page_views(s, stored(s, d, "panel"), instance=None))
SQL["lake_panel"] = f"{WA} {top(300)}"


def _beacon_files(s, d):
    path = shared_dir(s, f"beacon_files/{uuid4().hex}")
    fx.beacons(s, d).write.mode("overwrite").option("timestampNTZFormat", MICROS).json(path)
    return src.read_beacons(s, path)


QUERIES["beacon_json_files"] = _beacon_files
SQL["beacon_json_files"] = fx.sql(fx.BEACONS)


def _messages(s, d):
    beacons = fx.beacons(s, d)
    read = src.from_messages(beacons.select(F.to_json(F.struct(*beacons.columns), {"timestampNTZFormat": MICROS}).cast("binary").alias("value")))
    return read.drop("broken")


QUERIES["beacon_messages"] = _messages
SQL["beacon_messages"] = fx.sql(fx.BEACONS)


def _export(s, d):
    path = shared_dir(s, f"panel_export/{uuid4().hex}")
    export.write_panel(panels.panel(fx.page_views(s, d)), path)
    return export.read_panel(s, path)


QUERIES["panel_export"] = _export
SQL["panel_export"] = f"{WA} {top(300)}"


def _export_streams(s, d):
    """Every row of the Arrow streams, read back."""
    streams = export.panel_streams(panels.panel(fx.page_views(s, d)))
    parts = []
    for data in streams.values():
        table = pa.ipc.open_stream(data[4:]).read_all()
        group = pa.array([int.from_bytes(data[:4], "big")] * table.num_rows, pa.int32())
        parts.append(table.append_column("grouping_id", group))
    return s.createDataFrame(pa.concat_tables(parts)).select("grouping_id", "value", "count", "max")


QUERIES["panel_export_streams"] = _export_streams
SQL["panel_export_streams"] = f"{WA} {top(300)}"


def _export_chunks(s, d):
    """Every value of every dimension as pieces of Arrow streams, stored and read back."""
    path = shared_dir(s, f"panel_chunks/{uuid4().hex}")
    export.write_panel_streams(panels.panel(fx.page_views(s, d), limit=None), path)
    return export.read_chunks(s.read.schema("chunk long, data binary, grouping_id int").parquet(path))


QUERIES["panel_export_chunks"] = _export_chunks
SQL["panel_export_chunks"] = f'{WA} select grouping_id, value, "count", "max" from ({FULL})'


def _requests(s, d):
    """Beacons written as request targets and read back."""
    beacons = fx.beacons(s, d)
    told = src.to_requests(beacons)
    return src.from_requests(told, "request", F.col("received_at"), F.col("user_agent"), F.col("instance"), F.col("beacon_id"))


QUERIES["beacon_requests"] = _requests
SQL["beacon_requests"] = fx.sql(fx.BEACONS)


def _bracketed(s, d):
    """The page's query string in fields of its own, as q[name]=value; campaign values as ingest finds them."""
    pairs = uri.query_pairs(F.regexp_replace(ing.blank_to_null(F.col("q")), "^[?]+", ""))
    fields = F.transform(pairs, lambda p: F.concat(F.lit("q%5B"), F.url_encode(p["key"]), F.lit("%5D="), F.url_encode(p["value"])))
    request = F.concat(F.lit("GET /t?b=0&"), F.coalesce(F.array_join(fields, "&"), F.lit("")), F.lit(" HTTP/1.1"))
    read = src.from_requests(fx.beacons(s, d).select("beacon_id", request.alias("request")), beacon_id=F.col("beacon_id"))
    return ing.utm_columns(ing.cast_beacons(read)).select("beacon_id", *uri.ALLOWED_QUERY_KEYS)


QUERIES["beacon_bracketed_requests"] = _bracketed
SQL["beacon_bracketed_requests"] = INGEST_SQL["ingest_utm"]


def _mixed_batches(s, d):
    """Four small batches, two of them compacted and not removed: each event is read once."""
    root = shared_dir(s, f"mixed/{uuid4().hex}")
    events = stored_events(s, d)
    for n in range(4):
        part = F.pmod(F.unix_timestamp("timestamp"), F.lit(4)) == n
        lake.write_events(events.where(part), f"{root}/recent", str(n))
    lake.compact_upto(s, f"{root}/recent", f"{root}/compacted", 1)
    read = lake.read_compacted(s, f"{root}/compacted", f"{root}/recent", 1, instance=None)
    return _columns(read)


QUERIES["lake_compacted_and_recent"] = _mixed_batches
SQL["lake_compacted_and_recent"] = _SCAN_SQL


def _broken_messages(s, d):
    """A third of the messages is cut off; each gets a reason and keeps its text."""
    beacons = fx.beacons(s, d)
    text = F.to_json(F.struct(*beacons.columns), {"timestampNTZFormat": MICROS})
    cut = F.when(F.col("beacon_id") % 3 == 0, F.substr(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    rows = beacons.select(cut.alias("value"), F.col("instance").alias("tenant"))
    ingested = ing.ingest(src.from_messages(rows, instance=F.col("tenant")), fx.registry(s, d), fx.lookups(s))
    counted = ingested.withColumn("broken", F.col("broken").isNotNull()).groupBy("broken", "instance", "reason")
    return counted.agg(F.count("*").alias("count"))


QUERIES["beacon_broken_messages"] = _broken_messages
SQL["beacon_broken_messages"] = f"""{FULL_SQL} select beacon_id % 3 = 0 as broken, instance,
  case when beacon_id % 3 = 0 then 'invalid_params' else reason end as reason, count(*) as "count" from ingested group by all"""

_NULL_SITES = QuerySpec(filters={"services": ["svc-7", ""]})


def _null_sites(s, d):
    """Events that lost their site are found by the empty text in a site filter."""
    path = shared_dir(s, f"null_sites/{uuid4().hex}")
    events = stored_events(s, d).withColumn("entity_id", F.nullif("entity_id", F.lit("svc-0")))
    lake.write_events(events, path, "all")
    return lake.read_page_views(s, path, _NULL_SITES, None)


QUERIES["lake_null_sites"] = _null_sites
SQL["lake_null_sites"] = f"""{TRACKED} select nullif(entity_id, 'svc-0') as service_id, "timestamp", {_DIMENSIONS} from tracked
  where "type" = 'pageview' and entity_id in ('svc-0', 'svc-7')"""
