"""Names, schemas and grouping ids shared by every part of the library."""

from __future__ import annotations

from pyspark.sql import types as T

# The thirteen page-view dimensions. Their order defines the
# grouping id of each dimension, so it must not change.
DIMENSIONS = (
    "namespace",
    "path",
    "referrer",
    "referrer_source",
    "utm_medium",
    "utm_source",
    "utm_campaign",
    "utm_content",
    "country_code",
    "operating_system",
    "operating_system_version",
    "browser",
    "browser_version",
)

PAGE_VIEW_TYPE = "pageview"
DEFAULT_INSTANCE = "main"
DEFAULT_LIMIT = 300
UNKNOWN_LABEL = "<Unknown>"


def grouping_id(dimension: str) -> int:
    """Bit mask of a dimension: first dimension = highest bit, 0 = grouped by it."""
    position = DIMENSIONS.index(dimension)
    width = len(DIMENSIONS)
    return (1 << width) - 1 - (1 << (width - 1 - position))


GROUPING_IDS = {dimension: grouping_id(dimension) for dimension in DIMENSIONS}

# Query filter name -> page-view column it tests.
FILTER_COLUMNS = {
    "utm_sources": "utm_source",
    "utm_campaigns": "utm_campaign",
    "utm_mediums": "utm_medium",
    "utm_contents": "utm_content",
    "namespaces": "namespace",
    "country_codes": "country_code",
    "referrers": "referrer",
    "sources": "referrer_source",
    "services": "service_id",
    "operating_systems": "operating_system",
    "operating_system_versions": "operating_system_version",
    "browsers": "browser",
    "browser_versions": "browser_version",
    "paths": "path",
}

PROPERTIES_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in DIMENSIONS])

# Columns that place an event in the table, coarsest first.
CLUSTER_COLUMNS = ("instance", "entity_id", "year", "month")

# Directory levels below a batch. ``site`` gives every site its own directories;
# ``sorted`` keeps sites together inside files, so that thousands of small
# sites do not make thousands of small files.
LAYOUTS = {
    "sorted": ("instance", "year", "month"),
    "site": ("instance", "entity_id", "year", "month"),
}


def event_schema(properties: T.DataType | None = None) -> T.StructType:
    """Schema of the stored event table for one encoding of ``properties``."""
    return T.StructType(
        [
            T.StructField("timestamp", T.TimestampNTZType()),
            T.StructField("type", T.StringType()),
            T.StructField("properties", properties or PROPERTIES_TYPE),
            T.StructField("batch", T.StringType()),
            T.StructField("instance", T.StringType()),
            T.StructField("entity_id", T.StringType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
        ]
    )


PAGE_VIEW_SCHEMA = T.StructType(
    [
        T.StructField("service_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(name, T.StringType()) for name in DIMENSIONS],
    ]
)

# Raw browser beacon. Every field stays a string until ingest casts it, so a
# malformed value becomes a reject with a reason, not a parse failure.
BEACON_SCHEMA = T.StructType(
    [
        T.StructField("beacon_id", T.LongType()),
        T.StructField("instance", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("q", T.StringType()),
        T.StructField("r", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("i", T.StringType()),
        T.StructField("z", T.StringType()),
    ]
)

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("grouping_id", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("max", T.LongType()),
    ]
)
