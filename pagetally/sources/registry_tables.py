"""Stored registry: services and matchers as Parquet tables, one directory per load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.operators.registry import Registry, register_new
from pagetally.session import exists
from pagetally.sources.config_files import parse_config_files, read_config_files

SERVICES = "service_id string, name string, published boolean, batch string"
MATCHERS = "matcher_id string, service_id string, type string, value string, batch string"


def _folder(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def write_registry(registry: Registry, path: str, batch: str) -> None:
    """Add services and matchers; the same label replaces its earlier load."""
    for table, rows in (("services", registry.services), ("matchers", registry.matchers)):
        rows.write.mode("overwrite").parquet(f"{_folder(path, table)}/batch={batch}")


def read_registry(spark: SparkSession, path: str, without_batch: str | None = None) -> Registry:
    """The stored registry; one that was never written is empty."""

    def table(name: str, schema: str) -> DataFrame:
        if not exists(spark, _folder(path, name)):
            return spark.createDataFrame([], schema).drop("batch")
        rows = spark.read.schema(schema).parquet(_folder(path, name))
        if without_batch is not None:
            rows = rows.where(F.col("batch") != without_batch)
        return rows.drop("batch")

    return Registry(table("services", SERVICES), table("matchers", MATCHERS))


def install_config(spark: SparkSession, path: str, batch: str, *folders: str) -> DataFrame:
    """Register the services declared in folders that the stored registry lacks; gives the faulty files.

    Repeatable: an earlier attempt under the same label is replaced, not counted as present.
    """
    services, matchers, errors = parse_config_files(read_config_files(spark, *folders))
    current = read_registry(spark, path, without_batch=batch)
    write_registry(register_new(services, matchers, current.services), path, batch)
    return errors
