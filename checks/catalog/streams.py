"""Structured Streaming over the whole events table."""

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.catalog.ingest import FULL_SQL
from pagetally.model import DIMENSIONS
from pagetally.operators import ingest as ing
from pagetally.plans.spec import QuerySpec
from pagetally.session import shared_dir
from pagetally.sources import lake
from pagetally.streaming import ingest_stream, series_stream

QUERIES, SQL = {}, {}

ONCE = {"availableNow": True}


def run_ingest(s, d, name, metrics=False):
    """Stream all beacons through ingest; gives the paths of events and rejects."""
    root = shared_dir(s, f"stream/{name}/{uuid4().hex}")
    query = ingest_stream.start_ingest(
        fx.beacon_stream(s, d),
        f"{root}/events",
        f"{root}/rejects",
        f"{root}/checkpoint",
        lambda: fx.registry(s, d),
        lambda: fx.lookups(s),
        ONCE,
        metrics_path=f"{root}/metrics" if metrics else None,
    )
    query.awaitTermination()
    return f"{root}/metrics" if metrics else (f"{root}/events", f"{root}/rejects")


def _events(s, d):
    events, _ = run_ingest(s, d, "events")
    read = lake.read_events(s, events, instance=None)
    return read.select("instance", "entity_id", "timestamp", "type", "properties.*")


QUERIES["stream_ingest_events"] = _events
SQL["stream_ingest_events"] = f"""{FULL_SQL} select instance, service_id as entity_id, "timestamp", 'pageview' as "type",
  {", ".join(f"nullif({d}, '') as {d}" for d in DIMENSIONS)} from ingested where reason is null"""


def _rejects(s, d):
    _, rejects = run_ingest(s, d, "rejects")
    return ingest_stream.read_rejects(s, rejects).groupBy("instance", "reason").agg(F.count("*").alias("count"))


QUERIES["stream_ingest_rejects"] = _rejects
SQL["stream_ingest_rejects"] = f"""{FULL_SQL} select instance, reason, count(*) as "count" from ingested
  where reason is not null group by all"""


def _progress(s, d):
    """Accepted rows per tenant over all micro-batches."""
    events, _ = run_ingest(s, d, "progress")
    counts = ingest_stream.batch_progress(lake.read_events(s, events, instance=None))
    return counts.groupBy("instance").agg(F.sum("count").alias("count"))


QUERIES["stream_progress"] = _progress
SQL["stream_progress"] = f"""{FULL_SQL} select instance, count(*) as "count" from ingested where reason is null group by instance"""


def _tenant(s, d):
    events, _ = run_ingest(s, d, "tenant")
    spec = QuerySpec(interval="past_14_days", as_of=datetime(2024, 1, 20, 12, 34, 56))
    return lake.read_page_views(s, events, spec, "acme")


QUERIES["stream_tenant_views"] = _tenant
SQL["stream_tenant_views"] = f"""{FULL_SQL} select service_id, "timestamp",
  {", ".join(f"nullif({d}, '') as {d}" for d in DIMENSIONS)} from ingested
  where reason is null and instance = 'acme' and "timestamp" >= timestamp '2024-01-06 12:34:00'"""


def _scale(unit):
    def query(s, d):
        root = shared_dir(s, f"stream/scale/{uuid4().hex}")
        events = fx.event_stream(s, d).withColumnRenamed("ts", "timestamp")
        counted = series_stream.stream_scale(events, unit)
        series_stream.start_scale(counted, f"{root}/periods", f"{root}/checkpoint", ONCE).awaitTermination()
        return series_stream.read_scale(s, f"{root}/periods")

    return query


for _name in ("hour", "day", "week", "month", "year"):
    QUERIES[f"stream_scale_{_name}"] = _scale(_name)
    SQL[f"stream_scale_{_name}"] = f"""select date_trunc('{_name}', ts)::timestamp as period, count(*) as "count"
      from events group by 1"""


def _batch_counts(s, d):
    events, rejects = run_ingest(s, d, "counts")
    counts = ingest_stream.batch_counts(lake.read_events(s, events, instance=None), ingest_stream.read_rejects(s, rejects))
    return counts.agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected", "received")))


QUERIES["stream_batch_counts"] = _batch_counts
SQL["stream_batch_counts"] = f"""{FULL_SQL} select count(*) filter (reason is null) as accepted,
  count(*) filter (reason is not null) as rejected, count(*) as received from ingested"""


def _metrics(s, d):
    """Numbers told by the stream itself, without reading its tables."""
    metrics = ingest_stream.read_metrics(s, run_ingest(s, d, "metrics", metrics=True))
    return metrics.groupBy("reason").agg(F.sum("count").alias("count"))


QUERIES["stream_metrics"] = _metrics
_REASONS = ", ".join(f"('{reason}')" for reason in ing.REASONS)
SQL["stream_metrics"] = f"""{FULL_SQL}, named as (select cast(null as varchar) as reason union all select * from (values {_REASONS}))
  select n.reason, count(i.beacon_id) as "count" from named n left join ingested i on n.reason is not distinct from i.reason group by n.reason"""


def _closed(unit):
    def query(s, d):
        root = shared_dir(s, f"stream/closed/{uuid4().hex}")
        events = fx.event_stream(s, d).withColumnRenamed("ts", "timestamp")
        series_stream.start_closed_scale(events, unit, f"{root}/series", f"{root}/checkpoint", "2 hours", ONCE).awaitTermination()
        closed = series_stream.read_closed(s, f"{root}/series").withColumn("closed", F.lit(True))
        return closed.unionByName(series_stream.read_open(s, f"{root}/series").withColumn("closed", F.lit(False)))

    return query


for _name in ("hour", "day", "week", "month"):
    QUERIES[f"stream_closed_{_name}"] = _closed(_name)
    SQL[f"stream_closed_{_name}"] = f"""select date_trunc('{_name}', ts)::timestamp as period, count(*) as "count",
      date_trunc('{_name}', ts)::timestamp + interval 1 {_name} + interval 2 hours <= (select max(ts) from events) as closed
      from events group by 1"""
