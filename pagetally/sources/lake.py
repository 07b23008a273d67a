"""The partitioned event table and the page-view view on it.

One write is one directory ``batch=<label>``; repeating a write with the same
label replaces it, so a retried job or micro-batch never counts twice. Below
it, events are partitioned by instance, year and month, with or without a
directory level per site (see ``LAYOUTS``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.predicates import where_in
from pagetally.model import (
    CLUSTER_COLUMNS,
    DEFAULT_INSTANCE,
    DIMENSIONS,
    LAYOUTS,
    PAGE_VIEW_TYPE,
    PROPERTIES_TYPE,
    event_schema,
)
from pagetally.plans.spec import QuerySpec

ENCODINGS = ("struct", "json", "variant")


def encode_properties(properties: Column, encoding: str) -> Column:
    """Properties struct as it is stored; ``json`` and ``variant`` leave NULLs out."""
    if encoding == "struct":
        return properties
    if encoding == "json":
        return F.to_json(properties)
    if encoding == "variant":
        return F.parse_json(F.to_json(properties))
    raise ValueError(f"unknown encoding: {encoding!r}; known: {', '.join(ENCODINGS)}")


def property_column(properties: Column, kind: T.DataType, key: str) -> Column:
    """One property as text; missing and null are both NULL."""
    if isinstance(kind, T.StructType):
        return properties[key]
    return F.try_variant_get(properties, f"$.{key}", "string")


def with_timestamp(events: DataFrame) -> DataFrame:
    """Fill a missing event time with the time of the write, UTC."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return events.withColumn("timestamp", F.coalesce(F.col("timestamp"), now))


def _placed(events: DataFrame) -> DataFrame:
    return with_timestamp(events).withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})


def _save(
    rows: DataFrame,
    path: str,
    batch: str,
    layout: str,
    observed: Observation | None = None,
    within: Sequence[Column] = (),
    options: dict[str, str] | None = None,
) -> None:
    # Sorted by site and time, so row groups and pages have narrow ranges to skip by.
    # The writer needs the directory columns first, and none of them nullable: else it
    # sorts again, by them alone. An empty name and NULL are the same directory.
    folders = LAYOUTS[layout]
    named = {c: F.coalesce(c, F.lit("")) for c in folders if c not in ("year", "month")}
    named |= {c: F.coalesce(c, F.lit(0)) for c in ("year", "month")}
    order = [*folders, *(c for c in CLUSTER_COLUMNS if c not in folders), *within, "timestamp"]
    if observed is not None:
        rows = rows.observe(observed, F.count(F.lit(1)).alias("rows"))
    (
        rows.withColumns(named)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy(*LAYOUTS[layout])
        .option("compression", "zstd")
        .options(**(options or {}))
        .parquet(f"{path.rstrip('/')}/batch={batch}")
    )


def write_events(
    events: DataFrame,
    path: str,
    batch: str,
    encoding: str = "struct",
    layout: str = "sorted",
    observed: Observation | None = None,
) -> None:
    """Store events (instance, entity_id, timestamp, type, properties struct) as one batch.

    REBALANCE brings the rows of a site and month together in files of the
    advisory size: a site with most of the rows is split over many tasks, small
    ones share a task. One table has one layout.
    """
    rows = _placed(events).withColumn("properties", encode_properties(F.col("properties"), encoding))
    rows = rows.select("timestamp", "type", "properties", *CLUSTER_COLUMNS)
    _save(rows.hint("rebalance", *CLUSTER_COLUMNS), path, batch, layout, observed)


def properties_type(encoding: str) -> T.DataType | None:
    return {"struct": None, "json": T.StringType(), "variant": T.VariantType()}[encoding]


def read_events(
    spark: SparkSession,
    path: str,
    spec: QuerySpec | None = None,
    instance: str | None = DEFAULT_INSTANCE,
    encoding: str = "struct",
    after: int | None = None,
) -> DataFrame:
    """Events of one tenant (``instance=None``: of all), with partitions pruned by the spec.

    ``after`` leaves out the numbered batches up to that one, which a compacted
    table has already (see ``read_compacted``). Only year and month bounds and the site filter are taken from the spec here;
    apply the whole spec to the page views.
    """
    events = spark.read.schema(event_schema(properties_type(encoding))).parquet(path)
    if after is not None:
        events = events.where(F.col("batch").cast("long") > after)
    if instance is not None:
        events = events.where(F.col("instance") == instance)
    if spec is not None:
        for test in spec.month_predicates():
            events = events.where(test)
        sites = spec.filters.get("services")
        if sites:
            events = events.where(where_in(F.col("entity_id"), sites))
    return events


def page_views(events: DataFrame) -> DataFrame:
    """The view every report reads: page views only, thirteen text columns."""
    if isinstance(events.schema["properties"].dataType, T.StringType):  # the text is read once for all columns
        events = events.withColumn("properties", F.from_json("properties", PROPERTIES_TYPE))
    kind = events.schema["properties"].dataType
    properties = F.col("properties")
    return events.where(F.col("type") == PAGE_VIEW_TYPE).select(
        F.col("entity_id").alias("service_id"),
        "timestamp",
        *[property_column(properties, kind, d).alias(d) for d in DIMENSIONS],
    )


def read_page_views(
    spark: SparkSession,
    path: str,
    spec: QuerySpec | None = None,
    instance: str | None = DEFAULT_INSTANCE,
    encoding: str = "struct",
) -> DataFrame:
    """Page views of one tenant under a spec, filters included."""
    views = page_views(read_events(spark, path, spec, instance, encoding))
    return spec.apply(views) if spec is not None else views


def read_compacted(spark: SparkSession, compacted: str, recent: str, upto: int, **options) -> DataFrame:
    """Events of the compacted table, which has the batches up to ``upto``, and of the later ones.

    Every event once, also while compaction and the stream go on: the bound alone
    decides which table a batch is read from.
    """
    old = read_events(spark, compacted, **options).where(F.col("batch") == str(upto))
    return old.unionByName(read_events(spark, recent, after=upto, **options))


def compact_upto(spark: SparkSession, source: str, target: str, upto: int, encoding: str = "struct", layout: str = "sorted") -> None:
    """Rewrite the numbered batches up to ``upto`` as batch ``upto`` of the table at ``target``."""
    events = read_events(spark, source, instance=None, encoding=encoding).where(F.col("batch").cast("long") <= upto)
    rows = events.select("timestamp", "type", "properties", *CLUSTER_COLUMNS)
    _save(rows.repartitionByRange("instance", "entity_id", "timestamp"), target, str(upto), layout)


def interleaved(values: Sequence[Column], bits: int) -> Column:
    """One number from the lowest ``bits`` bits of each value, taken in turn from the highest down."""
    if bits * len(values) > 63:
        raise ValueError("too many bits for one number")
    key = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for value in values:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(value.cast("long"), bit).bitwiseAND(F.lit(1)))
    return key


def skip_key(dimensions: Sequence[str]) -> Column:
    """Sort key that keeps rows of one value of any of the dimensions, and of one time of the month, together.

    Dimensions count by a hash, so frequent and rare values alike get their share of the
    key, whatever their text; NULL is a value.
    """
    unknown = [d for d in dimensions if d not in DIMENSIONS]
    if unknown:
        raise ValueError(f"unknown dimensions: {', '.join(unknown)}")
    bits = min(8, 63 // (len(dimensions) + 1))
    hour = (F.dayofmonth("timestamp") - 1) * 24 + F.hour("timestamp")
    part = F.floor(hour * (1 << bits) / (31 * 24))
    hashed = [F.pmod(F.xxhash64(F.col("properties")[d]), F.lit(1 << bits)) for d in dimensions]
    return interleaved([*hashed, part], bits)


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    batch: str,
    batches: Sequence[str] | None = None,
    encoding: str = "struct",
    layout: str = "sorted",
    skip_by: Sequence[str] = (),
    row_group_bytes: int | None = None,
) -> None:
    """Rewrite batches of ``source`` (all, or the named ones) as one batch of the table at ``target``.

    Rows are spread by ranges of (instance, site, time): a site lies in few
    files, a site of any size in as many as it needs, and the file statistics
    let a site or time filter skip the rest. Repeatable: the same label replaces
    the earlier attempt. The source stays.

    With ``skip_by``, a site's rows of a month are ordered by a key that interleaves
    those dimensions with the time, and the dimensions get Bloom filters where their values
    are too many for a dictionary. A filter by one of them then skips most row groups too;
    one by time skips fewer than without. Needs properties stored as a struct.
    """
    if skip_by and encoding != "struct":
        raise ValueError("only properties stored as a struct have columns to skip by")
    events = read_events(spark, source, instance=None, encoding=encoding)
    if batches is not None:
        events = events.where(F.col("batch").isin(list(batches)))
    rows = events.select("timestamp", "type", "properties", *CLUSTER_COLUMNS)
    options = {"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {}
    if not skip_by:
        _save(rows.repartitionByRange("instance", "entity_id", "timestamp"), target, batch, layout, options=options)
        return
    options |= {f"parquet.bloom.filter.enabled#properties.{d}": "true" for d in skip_by}
    # months lie in directories of their own, so they come first: a task writes to few
    dealt = rows.repartitionByRange("instance", "year", "month", "entity_id", skip_key(skip_by), "timestamp")
    _save(dealt, target, batch, layout, within=[skip_key(skip_by)], options=options)
