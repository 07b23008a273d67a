"""Streams over several micro-batches: closed periods, late events, metrics, a kept registry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows_of

from checks import fixtures as fx
from pagetally.operators import ingest as ing
from pagetally.operators import registry as reg
from pagetally.operators import series
from pagetally.sources import beacons as beacons_source
from pagetally.sources import lake
from pagetally.streaming import ingest_stream, series_stream

ONCE = {"availableNow": True}


def in_batches(spark, frames, folder):
    """A stream that gives one frame per micro-batch, in order."""
    schema = frames[0].schema
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    files = sorted(folder.glob("part=*/*.parquet"))
    for i, file in enumerate(files):  # the source takes files by time
        import os

        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_closed_periods_and_late_events(spark, tmp_path):
    """Ten micro-batches out of order: closed counts are final, late rows are kept, the sum is the batch series."""
    draw, start = random.Random(5), datetime(2024, 1, 1)
    moments = [[start + timedelta(minutes=30 * b + draw.randint(-400, 60)) for _ in range(40)] for b in range(10)]
    frames = [spark.createDataFrame([(m,) for m in batch], "timestamp timestamp_ntz") for batch in moments]
    events = in_batches(spark, frames, tmp_path / "events")
    path = str(tmp_path / "series")
    series_stream.start_closed_scale(events, "hour", path, str(tmp_path / "cp"), "2 hours", ONCE).awaitTermination()

    # the same by hand
    hour = timedelta(hours=1)
    closed, late, open_, last = {}, [], {}, None
    for b, batch in enumerate(moments):
        mark = last
        last = max([*batch, *([last] if last else [])])
        for m in batch:
            p = m.replace(minute=0, second=0)
            if mark and p + hour + 2 * hour <= mark:
                late.append((b, p))
            else:
                open_[p] = open_.get(p, 0) + 1
        for p in [p for p in open_ if p + 3 * hour <= last]:
            assert p not in closed
            closed[p] = open_.pop(p)
    assert late and len(closed) > 3 and open_
    assert dict(rows_of(series_stream.read_closed(spark, path))) == closed
    assert dict(rows_of(series_stream.read_open(spark, path))) == open_
    assert series_stream.read_late(spark, path).agg(F.sum("count")).first()[0] == len(late)

    every = spark.createDataFrame([(m,) for batch in moments for m in batch], "timestamp timestamp_ntz")
    assert rows_of(series_stream.read_all_periods(spark, path)) == rows_of(series.scale(every, "hour"))


def test_closed_periods_survive_a_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    frames = [spark.createDataFrame([(start + timedelta(hours=h),)] * (h + 1), "timestamp timestamp_ntz") for h in range(6)]
    path, cp = str(tmp_path / "series"), str(tmp_path / "cp")
    for part in (frames[:2], frames):
        events = in_batches(spark, part[-4:] if part is frames else part, tmp_path / "events")
        series_stream.start_closed_scale(events, "hour", path, cp, "1 hour", ONCE).awaitTermination()
    assert [r["count"] for r in series_stream.read_closed(spark, path).orderBy("period").collect()] == [1, 2, 3, 4]
    assert series_stream.read_all_periods(spark, path).agg(F.sum("count")).first()[0] == 21
    with pytest.raises(ValueError):
        series_stream.start_closed_scale(events, "minute", path, cp)


def test_metrics_equal_the_tables(spark, sf_dir, tmp_path):
    beacons = fx.beacons(spark, sf_dir)
    frames = [beacons.where(F.col("beacon_id") % 3 == i) for i in range(3)] + [beacons.limit(0)]
    stream = in_batches(spark, frames, tmp_path / "beacons")
    events, rejects, metrics = (str(tmp_path / n) for n in ("events", "rejects", "metrics"))
    ingest_stream.start_ingest(
        stream, events, rejects, str(tmp_path / "cp"), lambda: fx.registry(spark, sf_dir), lambda: fx.lookups(spark), ONCE, metrics_path=metrics
    ).awaitTermination()
    told = ingest_stream.read_metrics(spark, metrics)
    want = ingest_stream.batch_counts(lake.read_events(spark, events, instance=None), ingest_stream.read_rejects(spark, rejects))
    totals = ingest_stream.metric_totals(told).where("received > 0")
    assert rows_of(totals, "batch", "accepted", "rejected", "received") == rows_of(want, "batch", "accepted", "rejected", "received")
    assert want.count() == 3
    by_reason = ingest_stream.read_rejects(spark, rejects).groupBy("batch", "reason").agg(F.count("*").alias("count"))
    assert rows_of(told.where("reason is not null and count > 0")) == rows_of(by_reason)


def test_kept_registry(spark, sf_dir):
    loads, version = [], ["a"]

    def load():
        loads.append(1)
        return fx.registry(spark, sf_dir)

    kept = ingest_stream.KeptRegistry(load, lambda: version[0], seconds=1000)
    assert kept() is kept() and len(loads) == 1
    version[0] = "b"
    assert isinstance(kept(), reg.Registry) and len(loads) == 2
    kept.until = 0.0  # its time is over
    kept()
    assert len(loads) == 3
    kept.drop()
    kept()
    assert len(loads) == 4
    kept.drop()


def test_a_stream_reads_a_kept_registry_once(spark, sf_dir, tmp_path):
    beacons = fx.beacons(spark, sf_dir)
    stream = in_batches(spark, [beacons.where(F.col("beacon_id") % 2 == i) for i in range(2)], tmp_path / "beacons")
    loads = []

    def load():
        loads.append(1)
        return fx.registry(spark, sf_dir)

    kept = ingest_stream.KeptRegistry(load, seconds=1000)
    events = str(tmp_path / "events")
    ingest_stream.start_ingest(stream, events, str(tmp_path / "rejects"), str(tmp_path / "cp"), kept, lambda: fx.lookups(spark), ONCE).awaitTermination()
    assert len(loads) == 1
    want = ing.accepted(ing.ingest(beacons, fx.registry(spark, sf_dir), fx.lookups(spark))).count()
    assert lake.read_events(spark, events, instance=None).count() == want
    kept.drop()


def test_beacons_in_query_strings(spark):
    lines = {
        "GET /t?b=0&p=%2Fx&q[utm_source]=a+b&q%5Butm_medium%5D=c%26d&o=https%3A%2F%2Fe.org&i=s HTTP/1.1": ("0", "/x", "utm_source=a%20b&utm_medium=c%26d", None, "https://e.org", "s", None),
        "/t?q=%3Futm_source%3Dx&r=&z=Europe/Paris#f": (None, None, "?utm_source=x", "", None, None, "Europe/Paris"),
        "b=1&b=true&other=2&q[x]=%zz": ("true", None, "x=%25zz", None, None, None, None),
        "https://h.org/t": (None,) * 7,
        "": (None,) * 7,
        None: (None,) * 7,
    }
    rows = spark.createDataFrame([(t, "agent") for t in lines], "request string, agent string")
    read = beacons_source.from_requests(rows, "request", user_agent=F.col("agent"), instance=F.lit("main"))
    got = read.collect()
    assert [tuple(r[c] for c in "bpqroiz") for r in got] == list(lines.values())
    assert {(r.user_agent, r.instance, r.beacon_id) for r in got} == {("agent", "main", None)}
