from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of, rows_of

from checks import fixtures as fx
from pagetally.model import DIMENSIONS, GROUPING_IDS, PAGE_VIEW_SCHEMA
from pagetally.operators import panels, series
from pagetally.plans import reports
from pagetally.plans.spec import QuerySpec
from pagetally.sources import export


def test_grouping_ids():
    assert GROUPING_IDS["namespace"] == 0b0111111111111
    assert GROUPING_IDS["country_code"] == 8175
    assert GROUPING_IDS["browser_version"] == 8190
    assert len(set(GROUPING_IDS.values())) == 13


def brute_force(views, limit):
    out = []
    for d in DIMENSIONS:
        counts = Counter(v[d] for v in views)
        ordered = sorted(counts.items(), key=lambda e: (-e[1], e[0] is not None, e[0] or ""))
        out += [(GROUPING_IDS[d], value, n, ordered[0][1]) for value, n in ordered[:limit]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("form", ["explode", "grouping_sets"])
@pytest.mark.parametrize("limit", [1, 3, 300])
def test_panel_equals_brute_force(spark, sf_dir, form, limit):
    views = fx.page_views(spark, sf_dir)
    assert rows_of(panels.panel(views, limit, form)) == brute_force(views.collect(), limit)


def test_uncut_panel(spark, sf_dir):
    views = fx.page_views(spark, sf_dir)
    assert rows_of(panels.panel(views, None)) == brute_force(views.collect(), None)


def test_counts_of_each_dimension_add_up(spark, sf_dir):
    views = fx.page_views(spark, sf_dir)
    total = views.count()
    sums = panels.panel_counts(views).groupBy("grouping_id").agg(F.sum("count").alias("n")).collect()
    assert len(sums) == 13 and {r["n"] for r in sums} == {total}


def test_rows_come_in_panel_order(spark, sf_dir):
    rows = panels.panel(fx.page_views(spark, sf_dir)).collect()
    keys = [(r["grouping_id"], -r["count"], r["value"] is not None, r["value"] or "") for r in rows]
    assert keys == sorted(keys)


def test_unknown_form(spark, sf_dir):
    with pytest.raises(ValueError):
        panels.panel(fx.page_views(spark, sf_dir), form="cube")


def test_plan_cuts_before_the_shuffle(spark, sf_dir):
    plan = plan_of(panels.panel(fx.page_views(spark, sf_dir)))
    assert "WindowGroupLimit" in plan
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_value_is_counted_before_the_shuffle(spark):
    """One value in most rows: partial counts reach the shuffle, not the rows."""
    views = spark.range(50_000, numPartitions=4).select(
        F.lit("svc-0").alias("service_id"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("timestamp"),
        *[F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias(d) for d in DIMENSIONS],
    )
    top = panels.panel(views, 2).where(F.col("value") == "hot").collect()
    assert len(top) == 13 and {r["count"] for r in top} == {33_333}


def test_empty_input(spark):
    empty = spark.createDataFrame([], PAGE_VIEW_SCHEMA)
    frame = panels.present(panels.panel(empty))
    assert frame.count() == 0
    assert frame.columns == ["grouping_id", "value", "count", "max", "present"]
    assert export.panel_streams(panels.panel(empty)) == {}


def test_uncut_panel_is_exported_whole(spark, sf_dir):
    import pyarrow as pa

    panel = panels.panel(fx.page_views(spark, sf_dir), limit=None)
    rows = sum(pa.ipc.open_stream(s[4:]).read_all().num_rows for s in export.panel_streams(panel).values())
    assert rows == panel.count()


def test_export_has_no_limit(spark, tmp_path):
    """More than 100,000 rows, in pieces that no task and not the driver holds together."""
    import pyarrow as pa

    views = spark.range(130_000).select(
        F.lit("s").alias("service_id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        *[F.col("id").cast("string").alias(d) if d == "path" else F.lit("x").alias(d) for d in DIMENSIONS],
    )
    panel = panels.present(panels.panel(views, limit=None))
    export.write_panel_streams(panel, str(tmp_path / "streams"))
    chunks = spark.read.schema("chunk long, data binary, grouping_id int").parquet(str(tmp_path / "streams"))
    assert chunks.count() > 13 + 10
    assert rows_of(export.read_chunks(chunks, labelled=True)) == rows_of(panel)
    schema = pa.schema([("value", pa.string()), ("count", pa.int64()), ("max", pa.int64()), ("present", pa.string())])
    data = b"".join(export.iterate_stream(chunks, GROUPING_IDS["path"], schema))
    assert int.from_bytes(data[:4], "big") == GROUPING_IDS["path"]
    values = pa.ipc.open_stream(data[4:]).read_all().column("value").to_pylist()
    assert len(values) == 130_000 and values == sorted(values)
    assert list(export.iterate_stream(chunks.limit(0), GROUPING_IDS["path"])) == []


@pytest.mark.parametrize("limit", [1, 3, 7, 50, 999, 1000, 1500, 5000])
def test_thresholds_select_what_ranks_select(spark, limit):
    """Many ties, NULL among them, dimensions below and above the limit."""
    big = spark.range(3000).select(F.lit(1).alias("grouping_id"), F.col("id").cast("string").alias("value"), (1 + F.col("id") % 3).alias("count"))
    ties = spark.range(1000).select(F.lit(2).alias("grouping_id"), F.nullif(F.col("id").cast("string"), F.lit("5")).alias("value"), F.lit(4).cast("long").alias("count"))
    few = spark.createDataFrame([(3, None, 9), (3, "a", 9), (3, "b", 1)], "grouping_id int, value string, count long")
    counts = big.unionByName(ties).unionByName(few).repartition(7)
    assert rows_of(panels.top_values_by_threshold(counts, limit)) == rows_of(panels.top_values(counts, limit))


def test_a_limit_of_a_million(spark):
    counts = spark.range(1_500_000).select(
        F.lit(1).alias("grouping_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.lit(1).cast("long").alias("count")
    )
    top = panels.top_values_by_threshold(counts, 1_000_000)
    assert top.count() == 1_000_000
    assert top.agg(F.max("value")).first()[0] == counts.orderBy("value").limit(1_000_000).agg(F.max("value")).first()[0]
    # only the border range is ranked: no window over a whole dimension
    assert "Window" in plan_of(top) and "windowspecdefinition(grouping_id, value" not in plan_of(top)


def test_panel_of_one_dimension_reads_one_column(spark, sf_dir, tmp_path):
    fx.page_views(spark, sf_dir).write.parquet(str(tmp_path / "v"))
    views = spark.read.parquet(str(tmp_path / "v"))
    plan = plan_of(panels.panel_of(panels.panel(views, dimensions=("browser",)), "browser"))
    assert "ReadSchema: struct<browser:string>" in plan
    with pytest.raises(ValueError):
        panels.panel(views, form="grouping_sets", dimensions=("browser",))


def test_panel_streams(spark, sf_dir):
    import pyarrow as pa

    panel = panels.panel(fx.page_views(spark, sf_dir), 5)
    streams = export.panel_streams(panel)
    assert set(streams) == set(GROUPING_IDS.values())
    for group, data in streams.items():
        assert int.from_bytes(data[:4], "big") == group
        table = pa.ipc.open_stream(data[4:]).read_all()
        assert table.column_names == ["value", "count", "max"]
        want = panels.panel_of(panel, next(d for d, g in GROUPING_IDS.items() if g == group)).collect()
        assert table.column("value").to_pylist() == [r["value"] for r in want]


def test_labels(spark):
    cases = [
        ("referrer", "https://www.example.com/x", "www.example.com"),
        ("referrer", "news.example.com", "news.example.com"),
        ("referrer", "mailto:a@b", "mailto:a@b"),
        ("referrer", None, "<Unknown>"),
        ("country_code", "FR", "France"),
        ("country_code", "ZZ", "ZZ"),
        ("country_code", "", "<Unknown>"),
        ("browser", None, "<Unknown>"),
        ("browser", "Chrome", "Chrome"),
    ]
    rows = spark.createDataFrame(
        [(GROUPING_IDS[d], v, 1, 1, want) for d, v, want in cases],
        "grouping_id int, value string, count long, max long, want string",
    )
    labelled = panels.present(rows, fx.territories(spark))
    assert labelled.where(~F.col("present").eqNullSafe(F.col("want"))).collect() == []
    assert labelled.count() == len(cases)


def test_duplicate_territories_do_not_multiply(spark):
    rows = spark.createDataFrame([(8175, "FR", 1, 1)], "grouping_id int, value string, count long, max long")
    names = spark.createDataFrame([("FR", "France"), ("FR", "La France")], "country_code string, name string")
    assert panels.present(rows, names).count() == 1


def test_scope_is_closed_without_sites(spark, sf_dir):
    services = fx.registry(spark, sf_dir).services
    none = reports.visible_services(services, permitted=[])
    assert none.count() == 0
    assert reports.report(fx.page_views(spark, sf_dir), QuerySpec(), none).count() == 0
    # an empty request means "all permitted ones"
    assert reports.visible_services(services, requested=[]).count() == services.where("published").count()


def test_scale_rejects_unknown_unit(spark, sf_dir):
    with pytest.raises(ValueError):
        series.scale(fx.page_views(spark, sf_dir), "decade")
