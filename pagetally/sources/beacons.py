"""Beacon input, batch or stream: files, JSON messages or requests with a query string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions import uri
from pagetally.model import BEACON_SCHEMA


def read_beacons(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return spark.read.schema(BEACON_SCHEMA).format(file_format).load(path)


def stream_beacons(
    spark: SparkSession, path: str, file_format: str = "json", max_files_per_trigger: int = 1000
) -> DataFrame:
    """Files of a growing folder; Spark's checkpoint remembers what was read."""
    return (
        spark.readStream.schema(BEACON_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .format(file_format)
        .load(path)
    )


def from_messages(
    messages: DataFrame,
    column: str = "value",
    received_at: Column | None = None,
    user_agent: Column | None = None,
    instance: Column | None = None,
) -> DataFrame:
    """Beacons from JSON messages, for example the ``value`` of a Kafka topic.

    The text of a message that is no JSON object is kept in column ``broken``, and
    ingest rejects it as ``invalid_params``. Time, agent and tenant come from the
    given columns of ``messages``, such as the time and headers of a message; where
    one is not given or NULL, the message's own field counts.
    """
    text = F.col(column).cast("string")
    schema = T.StructType(list(BEACON_SCHEMA)).add("broken", "string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    outer = {"received_at": received_at, "user_agent": user_agent, "instance": instance}
    given = {name: value for name, value in outer.items() if value is not None}
    kept = [value.alias(f"__{name}") for name, value in given.items()]
    # a generator, so that every message is parsed once and not once per field
    rows = messages.select(text.alias("__text"), F.inline(F.array(parsed)), *kept)
    rows = rows.withColumns({name: F.coalesce(f"__{name}", name) for name in given})
    # an empty message or a bare null parses to nothing at all
    nothing = F.col("__text").isNull() | (F.trim("__text").isin("", "null"))
    broken = F.coalesce("broken", F.when(nothing, F.coalesce("__text", F.lit(""))))
    return rows.withColumn("broken", broken).drop("__text", *(f"__{name}" for name in given))


# The fields a tracker sends.
BEACON_FIELDS = ("b", "p", "q", "r", "o", "i", "z")

_REQUEST = "^(?:[A-Z]+ )?(.*?)(?: HTTP/[0-9.]+)?$"
_BRACKETED = "^q\\[(.*)\\]$"


def query_of(request: Column) -> Column:
    """The query string of a request line, a URL or a bare query string; NULL when a URL has none."""
    target = F.substring_index(F.regexp_extract(F.trim(request), _REQUEST, 1), "#", 1)
    at = F.instr(target, "?")
    bare = F.contains(target, F.lit("=")) & ~F.contains(F.substring_index(target, "=", 1), F.lit("/"))
    return F.when(at > 0, F.substr(target, at + 1)).when(bare, target)


def from_requests(
    requests: DataFrame,
    column: str = "request",
    received_at: Column | None = None,
    user_agent: Column | None = None,
    instance: Column | None = None,
    beacon_id: Column | None = None,
) -> DataFrame:
    """Beacons from requests that carry their fields in the query string, as web servers log them.

    ``column`` holds a request line, a URL or a bare query string. Names and values are form-decoded;
    of a repeated field the last counts. The page's own query string is the field ``q``, or is made
    of fields such as ``q[utm_source]``, in order. Other fields are ignored. A
    request without any field is a beacon without values. The remaining columns come from ``requests``.
    """
    given = {"beacon_id": beacon_id, "received_at": received_at, "user_agent": user_agent, "instance": instance}
    kinds = {f.name: f.dataType for f in BEACON_SCHEMA}
    outer = [(F.lit(None) if value is None else value).cast(kinds[name]).alias(name) for name, value in given.items()]
    pairs = uri.query_pairs(query_of(F.col(column).cast("string")), uri.form_decode)
    rows = requests.select(*outer, pairs.alias("__pairs"))
    inner = F.filter("__pairs", lambda pair: F.regexp_like(pair["key"], F.lit(_BRACKETED)))
    texts = F.transform(
        inner, lambda pair: F.concat(_encoded(F.regexp_extract(pair["key"], _BRACKETED, 1)), F.lit("="), _encoded(pair["value"]))
    )
    fields = {name: uri.last_value(F.col("__pairs"), name) for name in BEACON_FIELDS}
    fields["q"] = F.when(F.size(inner) > 0, F.array_join(texts, "&")).otherwise(fields["q"])
    return rows.withColumns(fields).select(*BEACON_SCHEMA.names)


def _encoded(text: Column) -> Column:
    """Percent-encoded so that RFC 3986 decoding gives the text back; a space is not a plus."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def to_requests(beacons: DataFrame, path: str = "/t") -> DataFrame:
    """Beacons as request targets with their fields in the query string; NULLs are left out."""
    told = [F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.url_encode(name))) for name in BEACON_FIELDS]
    outer = ("beacon_id", "instance", "received_at", "user_agent")
    return beacons.select(*outer, F.concat(F.lit(f"{path}?"), F.concat_ws("&", *told)).alias("request"))
