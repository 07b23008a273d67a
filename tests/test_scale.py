"""Behaviour under large or skewed inputs, provoked with small limits."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows_of

import __spark_entry__ as entry
from checks import fixtures as fx
from pagetally.operators import lookups as lk
from pagetally.operators import registry as reg
from pagetally.plans import reports


@pytest.fixture
def shuffled_joins(spark):
    """Nothing is broadcast and partitions count as skewed early."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark):
    """A third of the rows share one key, the rest are spread."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    return spark.range(0, 60_000, 1, 6).select("id", key.alias("service_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))


def test_lookup_splits_a_hot_key(spark, shuffled_joins):
    table = hot_rows(spark).select(F.col("service_id").alias("zone"), F.lit("FR").alias("country_code")).distinct()
    joined = lk.with_country(hot_rows(spark), F.col("service_id"), table)
    assert "skew=true" in final_plan(joined)
    assert joined.where("country_code = 'FR'").count() == 60_000


def test_scope_splits_a_hot_site(spark, shuffled_joins):
    sites = hot_rows(spark).select("service_id").distinct()
    scoped = reports.scope(hot_rows(spark), sites)
    assert "skew=true" in final_plan(scoped)
    assert scoped.count() == 60_000


def test_a_site_with_most_matchers_is_split(spark, shuffled_joins):
    matchers = hot_rows(spark).select(F.col("id").cast("string").alias("matcher_id"), "service_id", F.col("x").alias("value"))
    services = matchers.select("service_id").distinct().unionByName(spark.createDataFrame([("bare",)], "service_id string"))
    joined = reg.with_matchers(reg.Registry(services, matchers))
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 60_001
    assert joined.where("matcher_id is null").count() == 1


NAMES = ["panel_top300", "dashboard_report", "ingest_reasons", "ingest_all_columns_distinct", "stream_ingest_events", "stream_scale_hour"]


@pytest.mark.parametrize("name", NAMES)
def test_tables_in_many_files(spark, sf_dir, tmp_path_factory, name):
    """Tables may be folders of files; the stream then reads all of them."""
    folder = tmp_path_factory.mktemp("tables")
    for table in fx.TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(4).write.parquet(f"{folder}/{table}.parquet")
    query = entry.queries()[name]
    assert rows_of(query(spark, str(folder))) == rows_of(query(spark, sf_dir))
