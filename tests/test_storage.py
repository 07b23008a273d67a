import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of, rows_of

from checks import fixtures as fx
from checks.catalog.lake import stored_events
from pagetally.model import DIMENSIONS, LAYOUTS
from pagetally.operators import ingest as ing
from pagetally.operators import lookups as lk
from pagetally.operators import registry as reg
from pagetally.plans.spec import QuerySpec
from pagetally.session import configure, shared_dir
from pagetally.sources import beacons as src
from pagetally.sources import config_files, lake, registry_tables, synthetic
from pagetally.streaming import ingest_stream, series_stream


@pytest.mark.parametrize("layout", LAYOUTS)
def test_partitions_and_pushed_filters(spark, sf_dir, tmp_path, layout):
    path = str(tmp_path / "events")
    lake.write_events(stored_events(spark, sf_dir), path, "1", layout=layout)
    spec = QuerySpec({"services": ["svc-0"], "browsers": ["Chrome"]}, interval="last_month", as_of=datetime(2024, 2, 3))
    plan = plan_of(lake.read_page_views(spark, path, spec).select("path"))
    scan = plan[plan.index("PartitionFilters"):]
    partition_filters, pushed = scan.split("\n")[0], scan.split("PushedFilters")[1].split("\n")[0]
    assert "instance" in partition_filters and "year" in partition_filters and "month" in partition_filters
    assert "entity_id" in (partition_filters if layout == "site" else pushed)
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    assert "EqualTo(properties.browser,Chrome)" in pushed
    schema = scan.split("ReadSchema")[1].split("\n")[0]
    assert "path" in schema and "namespace" not in schema


def test_repeated_batch_replaces_itself(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    events = stored_events(spark, sf_dir)
    lake.write_events(events, path, "a")
    lake.write_events(events.where("type = 'pageview'"), path, "b")
    lake.write_events(events, path, "a")
    n = events.count()
    read = lake.read_events(spark, path, instance=None)
    assert read.count() == n + events.where("type = 'pageview'").count()
    assert {r["batch"] for r in read.select("batch").distinct().collect()} == {"a", "b"}


def data_files(path):
    return glob.glob(f"{path}/**/*.parquet", recursive=True)


def test_hot_site_is_split_over_files(spark, sf_dir, tmp_path):
    """With a small target size the site that has a third of the rows is written by several tasks."""
    path = str(tmp_path / "events")
    events = stored_events(spark, sf_dir).repartition(8)
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = {key: spark.conf.get(key) for key in keys}
    spark.conf.set(keys[0], "8KB")
    try:
        lake.write_events(events.where("instance = 'main'"), path, "1", layout="site")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = data_files(path)
    hot = [f for f in files if "entity_id=svc-0/" in f]
    assert len(hot) > 1
    assert lake.read_events(spark, path).count() == events.where("instance = 'main'").count()


def test_sorted_layout_makes_few_files(spark, sf_dir, tmp_path):
    events = stored_events(spark, sf_dir)
    for layout in LAYOUTS:
        lake.write_events(events, str(tmp_path / layout), "1", layout=layout)
    sites = events.select("instance", "entity_id").distinct().count()
    assert len(data_files(tmp_path / "site")) >= sites
    assert len(data_files(tmp_path / "sorted")) <= 8


def test_directories_are_listed_by_few_tasks(spark, tmp_path):
    """However many sites there are, a core gets a few tasks that list their directories."""
    sites = 60 * spark.sparkContext.defaultParallelism
    for n in range(sites):
        os.makedirs(tmp_path / f"batch=1/instance=main/entity_id=svc-{n}/year=2024/month=1")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        lake.read_events(configure(spark), str(tmp_path), instance=None)
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_compaction_keeps_every_event(spark, sf_dir, tmp_path):
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    events = stored_events(spark, sf_dir)
    for label in ("1", "2", "3"):
        lake.write_events(events, small, label)
    lake.compact(spark, small, large, "1-2", ["1", "2"], layout="site")
    assert lake.read_events(spark, large, instance=None).count() == 2 * events.count()


def test_missing_time_is_filled(spark, tmp_path):
    properties = F.struct(*[F.lit(None).cast("string").alias(d) for d in DIMENSIONS])
    events = spark.range(1).select(
        F.lit("main").alias("instance"), F.lit("a").alias("entity_id"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit("pageview").alias("type"), properties.alias("properties"),
    )
    lake.write_events(events, str(tmp_path / "e"), "1")
    assert lake.read_events(spark, str(tmp_path / "e")).first()["timestamp"].year >= 2024


def test_unknown_encoding():
    with pytest.raises(ValueError):
        lake.encode_properties(F.col("x"), "xml")


def test_stream_equals_batch_and_counts_progress(spark, sf_dir, tmp_path):
    beacons = fx.beacons(spark, sf_dir)
    source, events, rejects = (str(tmp_path / name) for name in ("beacons", "events", "rejects"))
    beacons.repartition(3).write.parquet(source)
    query = ingest_stream.start_ingest(
        src.stream_beacons(spark, source, "parquet", max_files_per_trigger=1), events, rejects, str(tmp_path / "check"),
        lambda: fx.registry(spark, sf_dir), lambda: fx.lookups(spark), {"availableNow": True},
    )
    query.awaitTermination()
    rows = ing.ingest(beacons, fx.registry(spark, sf_dir), fx.lookups(spark))
    columns = ("instance", "entity_id", "timestamp", "type", *[f"properties.{d}" for d in DIMENSIONS])
    assert rows_of(lake.read_events(spark, events, instance=None), *columns) == rows_of(ing.to_events(rows), *columns)
    assert rows_of(ingest_stream.read_rejects(spark, rejects), "beacon_id", "reason") == rows_of(
        ing.rejected(rows, beacons.columns), "beacon_id", "reason"
    )
    tables = lake.read_events(spark, events, instance=None), ingest_stream.read_rejects(spark, rejects)
    progress = ingest_stream.batch_counts(*tables).collect()
    assert len(progress) == 3 and sum(p["received"] for p in progress) == beacons.count()


def test_replayed_micro_batch_changes_nothing(spark, sf_dir, tmp_path):
    """A lost checkpoint makes the stream read everything again under the same batch numbers."""
    source = str(tmp_path / "beacons")
    fx.beacons(spark, sf_dir).repartition(2).write.parquet(source)

    def run(checkpoint):
        query = ingest_stream.start_ingest(
            src.stream_beacons(spark, source, "parquet", 100), str(tmp_path / "events"), str(tmp_path / "rejects"),
            str(tmp_path / checkpoint), lambda: fx.registry(spark, sf_dir), lambda: fx.lookups(spark), {"availableNow": True},
        )
        query.awaitTermination()
        return (
            lake.read_events(spark, str(tmp_path / "events"), instance=None).count(),
            ingest_stream.read_rejects(spark, str(tmp_path / "rejects")).count(),
        )

    first = run("one")
    assert sum(first) == fx.beacons(spark, sf_dir).count()
    assert run("one") == first
    assert run("two") == first


def test_registry_change_is_seen_by_the_next_micro_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "beacons")
    services = fx.registry(spark, sf_dir).services
    everything = reg.Registry(
        services, services.selectExpr("service_id as matcher_id", "service_id", "'regex' as type", "'.*' as value")
    )
    current = {"registry": reg.Registry(services, everything.matchers.where("false"))}

    def run():
        fx.beacons(spark, sf_dir).coalesce(1).write.mode("append").parquet(source)
        ingest_stream.start_ingest(
            src.stream_beacons(spark, source, "parquet"), str(tmp_path / "events"), str(tmp_path / "rejects"),
            str(tmp_path / "check"), lambda: current["registry"], lambda: fx.lookups(spark), {"availableNow": True},
        ).awaitTermination()
        return lake.read_events(spark, str(tmp_path / "events"), instance=None).count()

    assert run() == 0
    current["registry"] = everything
    assert run() > 0


def test_stream_scale_checks_units(spark, sf_dir):
    events = fx.tracked_events(spark, sf_dir)
    with pytest.raises(ValueError):
        series_stream.stream_scale(events, "decade")


def test_config_folders(spark, tmp_path):
    base, override = tmp_path / "usr", tmp_path / "etc"
    for folder in (base, override):
        os.makedirs(folder)
    (base / "a.conf").write_text("[Service]\nName=alpha\n\n[Matcher]\nType=exact\nValue=a.example\n[Matcher]\nType=glob\nValue=x\n")
    (base / "b.conf").write_text("; head = none\n[Service]\nName = beta\npublished = no\n")
    (base / "c.conf").write_text("[Matcher]\nType=exact\nValue=c.example\n")
    (base / "note.txt").write_text("[Service]\nName=ignored\n")
    (override / "b.conf").write_text("[Service]\r\nNAME=beta two\r\nPublished=yes\r\n[Matcher]\r\nType=regex\r\nValue=^b=[.]\r\n")
    files = config_files.read_config_files(spark, str(base), str(override))
    services, matchers, errors = config_files.parse_config_files(files)
    assert rows_of(services, "file", "name", "published") == [("a.conf", "alpha", True), ("b.conf", "beta two", True)]
    assert rows_of(matchers, "file", "type", "value") == [("a.conf", "exact", "a.example"), ("b.conf", "regex", "^b=[.]")]
    assert rows_of(errors) == [("a.conf", "invalid matcher"), ("c.conf", "missing service section")]
    current = spark.createDataFrame([("s", "alpha", False)], "service_id string, name string, published boolean")
    added = reg.register_new(services, matchers, current)
    assert rows_of(added.services, "name") == [("beta two",)]
    assert rows_of(added.matchers, "value") == [("^b=[.]",)]
    assert rows_of(reg.name_conflicts(services, current), "name") == [("alpha",)]


def test_install_config_is_repeatable(spark, tmp_path):
    folder, path = tmp_path / "conf", str(tmp_path / "registry")
    os.makedirs(folder)
    start = reg.Registry(
        spark.createDataFrame([("s1", "alpha", True), ("s2", "hidden", False)], "service_id string, name string, published boolean"),
        spark.createDataFrame([("m1", "s1", "exact", "a.example")], "matcher_id string, service_id string, type string, value string"),
    )
    registry_tables.write_registry(start, path, "start")
    (folder / "1.conf").write_text("[Service]\nName=alpha\n[Matcher]\nType=exact\nValue=other.example\n")
    (folder / "2.conf").write_text("[Service]\nName=hidden\n")
    (folder / "3.conf").write_text("[Service]\nName=new\n[Matcher]\nType=exact\nValue=n.example\n[Matcher]\nType=regex\nValue=n.example\n")
    (folder / "4.conf").write_text("[Service]\nName=new\npublished=0\n")
    (folder / "5.conf").write_text("Name=stray\n")
    for _ in range(2):
        errors = registry_tables.install_config(spark, path, "conf", str(folder))
        assert rows_of(errors) == [("5.conf", "missing service section")]
        stored = registry_tables.read_registry(spark, path)
        assert rows_of(stored.services, "name", "published") == [("alpha", True), ("hidden", False), ("new", True)]
        # one value once per service, the first section counts
        assert rows_of(stored.matchers, "type", "value") == [("exact", "a.example"), ("exact", "n.example")]
    assert rows_of(reg.matcher_counts(stored), "n") == [(0,), (1,), (1,)]


def test_configure_sizes_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, shuffle_bytes=1_000 * 128 * 1024 * 1024 + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1001"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_synthetic_rows_are_repeatable(spark):
    ids = synthetic.synth_ids(spark, 5000, ["a", "b"])
    one, two = synthetic.synth_page_views(ids, 1), synthetic.synth_page_views(ids.repartition(3), 1)
    assert rows_of(one) == rows_of(two)
    assert rows_of(one) != rows_of(synthetic.synth_page_views(ids, 2))
    share = one.where("path = '/'").count() / 5000
    assert abs(share - 300 / 372) < 0.05
    # browsers are spread alike whatever the campaign: the draws are independent
    by = one.groupBy("utm_campaign").agg(F.avg((F.col("browser") == "Chrome").cast("double")).alias("c"), F.count("*").alias("n"))
    shares = [r["c"] for r in by.collect() if r["n"] > 300]
    assert len(shares) > 1 and max(shares) - min(shares) < 0.12
    assert 0 < one.where("referrer is null").count() < 2500


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path.endswith(f"/pagetally/{spark.sparkContext.applicationId}/x")
    assert root is None or path.startswith(root)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from pagetally import session

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        session.shared_dir(Session, "x")


@pytest.mark.parametrize("layout", ["sorted", "site"])
def test_files_are_sorted_by_site_and_time(spark, tmp_path, layout):
    """In every file rows follow one another by site and time, and a compacted file too."""
    import pyarrow.parquet as pq

    moments = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(hash(id), 5000000))"
    rows = spark.range(20_000).selectExpr(
        "case when id % 7 = 0 then null else 'main' end as instance",
        "case when id % 3 = 0 then 'hot' when id % 11 = 0 then null else concat('s', pmod(hash(id), 97)) end as entity_id",
        f"{moments} as timestamp", "'pageview' as type",
        "named_struct(" + ", ".join(f"'{d}', 'x'" for d in DIMENSIONS) + ") as properties",
    )
    lake.write_events(rows, str(tmp_path / "e"), "1", layout=layout)
    lake.compact(spark, str(tmp_path / "e"), str(tmp_path / "c"), "1", layout=layout)
    for table in ("e", "c"):
        files = [f for f in glob.glob(f"{tmp_path}/{table}/**/*.parquet", recursive=True)]
        assert files
        for file in files:
            have = pq.ParquetFile(file).read().to_pylist()
            keys = [(r.get("entity_id") or "", r["timestamp"]) for r in have]
            assert keys == sorted(keys)
        assert lake.read_events(spark, str(tmp_path / table), instance=None).count() == 20_000
    assert lake.read_events(spark, str(tmp_path / "e"), instance=None).where("instance is null").count() > 0


def test_first_load_of_a_registry(spark, tmp_path):
    """Absent folders are empty, and so is a registry that was never written."""
    from pagetally.sources import config_files, registry_tables

    folder = tmp_path / "conf"
    folder.mkdir()
    (folder / "a.conf").write_text("[Service]\nname = A\n[Matcher]\ntype = exact\nvalue = a.org\n")
    path, absent = str(tmp_path / "registry"), str(tmp_path / "override")
    assert config_files.read_config_files(spark, absent).count() == 0
    assert registry_tables.read_registry(spark, path).services.count() == 0
    errors = registry_tables.install_config(spark, path, "1", str(folder), absent)
    assert errors.count() == 0
    stored = registry_tables.read_registry(spark, path)
    assert [r["name"] for r in stored.services.collect()] == ["A"] and stored.matchers.count() == 1


def test_many_small_batches_half_of_them_compacted(spark, tmp_path):
    schema = lake.event_schema()
    properties = {d: "x" for d in DIMENSIONS}
    from datetime import datetime

    for n in range(30):
        rows = [(datetime(2024, 1, 1 + n % 28), "pageview", properties, "main", f"s{n % 3}")]
        frame = spark.createDataFrame(rows, schema.fields and "timestamp timestamp_ntz, type string, properties struct<"
                                      + ",".join(f"{d}:string" for d in DIMENSIONS) + ">, instance string, entity_id string")
        lake.write_events(frame.coalesce(1), str(tmp_path / "recent"), str(n))
    lake.compact_upto(spark, str(tmp_path / "recent"), str(tmp_path / "old"), 14)
    both = lake.read_compacted(spark, str(tmp_path / "old"), str(tmp_path / "recent"), 14)
    columns = ("timestamp", "entity_id")
    assert both.count() == 30
    assert rows_of(both, *columns) == rows_of(lake.read_events(spark, str(tmp_path / "recent")), *columns)


def test_folded_series(spark, tmp_path):
    from datetime import datetime

    from pagetally.streaming import series_stream

    updates, folded = str(tmp_path / "u"), str(tmp_path / "f")
    for n in range(6):
        rows = [(datetime(2024, 1, 1 + n % 3), n + 1), (datetime(2024, 2, 1), 10 * n)]
        spark.createDataFrame(rows, "period timestamp_ntz, count long").coalesce(1).write.parquet(f"{updates}/batch={n}")
    want = rows_of(series_stream.read_scale(spark, updates))
    for upto in (2, 4):
        series_stream.fold_scale(spark, updates, folded, upto)
        assert rows_of(series_stream.read_scale(spark, updates, folded)) == want
    series_stream.fold_scale(spark, updates, folded, 4)  # a repeat changes nothing
    assert rows_of(series_stream.read_scale(spark, updates, folded)) == want


def test_sources_name_no_machine_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for file in glob.glob(f"{root}/pagetally/**/*.py", recursive=True):
        text = open(file).read()
        assert "localCheckpoint" not in text and "/tmp" not in text


def test_common_sources(spark):
    rows = spark.createDataFrame([("www.google.com",), ("mail.google.com",)], "h string")
    got = dict(rows_of(lk.with_referrer_source(rows, F.col("h"), lk.common_sources(spark)), "h", "referrer_source"))
    assert got == {"www.google.com": "Google", "mail.google.com": "Gmail"}


def _rows_scanned(frame):
    """(rows that the frame's scans hand on after skipping row groups and pages, rows of the result)."""
    count = len(frame.collect())
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), count


def test_compaction_by_dimensions_lets_filters_skip(spark, tmp_path):
    """Frequent paths, rare referrers and NULL are found in few row groups; the rows stay the same."""
    import pyarrow.parquet as pq

    moments = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(hash(id), 2600000))"
    values = {"path": "concat('/p', pmod(hash(id, 1), 60))", "referrer": "if(id % 50 = 0, null, concat('https://', xxhash64(id), '.org'))"}
    rows = spark.range(60_000).selectExpr(
        "'main' as instance", "'hot' as entity_id", f"{moments} as timestamp", "'pageview' as type",
        "named_struct(" + ", ".join(f"'{d}', {values.get(d, 'cast(null as string)')}" for d in DIMENSIONS) + ") as properties",
    )
    source, plain, skipping = (str(tmp_path / name) for name in ("e", "plain", "skipping"))
    lake.write_events(rows, source, "1")
    small = 16 * 1024
    lake.compact(spark, source, plain, "1", row_group_bytes=small)
    lake.compact(spark, source, skipping, "1", skip_by=["path", "referrer"], row_group_bytes=small)
    files = glob.glob(f"{skipping}/**/*.parquet", recursive=True)
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) >= 100  # a site of a real size has as many
    wanted = lake.read_events(spark, plain).where("properties.referrer is not null").first()["properties"]["referrer"]
    for spec in ({"paths": ["/p7"]}, {"referrers": [wanted]}):
        old, new = (lake.read_page_views(spark, path, QuerySpec(spec)) for path in (plain, skipping))
        assert rows_of(old) == rows_of(new)
        scanned, found = _rows_scanned(new)
        assert 0 < found <= scanned < 60_000 / 4
    assert _rows_scanned(lake.read_page_views(spark, plain, QuerySpec({"paths": ["/p7"]})))[0] > 60_000 / 4
    assert rows_of(lake.read_page_views(spark, plain)) == rows_of(lake.read_page_views(spark, skipping))


def test_compaction_by_dimensions_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        lake.compact(spark, "x", "y", "1", encoding="json", skip_by=["path"])
    with pytest.raises(ValueError):
        lake.skip_key(["colour"])


def test_interleaved_bits(spark):
    got = spark.range(64).select("id", lake.interleaved([F.shiftright("id", 3), F.col("id") % 8], 3).alias("key")).collect()
    for r in got:
        a, b = r["id"] >> 3, r["id"] % 8
        assert r["key"] == sum((a >> i & 1) << (2 * i + 1) | (b >> i & 1) << (2 * i) for i in range(3))


def test_variants_are_stored_in_typed_parts(spark, sf_dir, tmp_path):
    """A property of a variant has a column of its own; one filter and one column read that alone."""
    import pyarrow.parquet as pq

    def column_bytes(path, part):
        total = 0
        for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
                total += sum(c.total_compressed_size for c in columns if c.path_in_schema.startswith(part))
        return total

    typed, whole = str(tmp_path / "typed"), str(tmp_path / "whole")
    events = stored_events(spark, sf_dir)
    lake.write_events(events, typed, "1", "variant")
    spark.conf.set("spark.sql.variant.writeShredding.enabled", "false")
    try:
        lake.write_events(events, whole, "1", "variant")
    finally:
        configure(spark)
    part = "properties.typed_value.country_code"
    assert 0 < column_bytes(typed, part) < column_bytes(whole, "properties") / 4
    assert column_bytes(whole, part) == 0
    spec = QuerySpec({"country_codes": ["FR", "DE"]})
    old, new = (lake.read_page_views(spark, p, spec, None, "variant").select("service_id", "country_code") for p in (whole, typed))
    assert rows_of(old) == rows_of(new)
    assert rows_of(lake.read_page_views(spark, typed, None, None, "variant")) == rows_of(lake.read_page_views(spark, whole, None, None, "variant"))
    plan = plan_of(new)
    assert "PushedFilters" in plan and "properties.`0`" in plan  # the typed part's own statistics are asked
    assert "variant" not in plan.split("ReadSchema:")[1].split("\n")[0]
