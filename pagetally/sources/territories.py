"""Country lookups from the public time-zone database files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_FILE = "/usr/share/zoneinfo/zone.tab"
COUNTRY_FILE = "/usr/share/zoneinfo/iso3166.tab"


def _tab_fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return lines.select(F.split("value", "\t").alias("f"))


def zone_territories(spark: SparkSession, path: str = ZONE_FILE) -> DataFrame:
    """(zone, country_code). On a cluster give a path every executor can read."""
    f = F.col("f")
    return _tab_fields(spark, path).select(f[2].alias("zone"), f[0].alias("country_code"))


def territory_names(spark: SparkSession, path: str = COUNTRY_FILE) -> DataFrame:
    """(country_code, name)."""
    f = F.col("f")
    return _tab_fields(spark, path).select(f[0].alias("country_code"), f[1].alias("name"))
