"""Panel export: a partitioned table, or one Arrow stream per dimension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.model import PANEL_SCHEMA
from pagetally.operators.panels import ordered


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").partitionBy("grouping_id").parquet(path)


def read_panel(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    schema = T.StructType(list(PANEL_SCHEMA))
    if labelled:
        schema = schema.add("present", T.StringType())
    return spark.read.schema(schema).parquet(path)


# One row of a panel in an Arrow stream: all columns but the dimension's id.
_STREAM = pa.schema([("value", pa.string()), ("count", pa.int64()), ("max", pa.int64())])

# Fixed value: what ends an Arrow stream.
_END = b"\xff\xff\xff\xff\x00\x00\x00\x00"

CHUNK_SCHEMA = "grouping_id int, chunk long, data binary"


def _schema_of(panel: DataFrame) -> pa.Schema:
    return _STREAM.append(pa.field("present", pa.string())) if "present" in panel.columns else _STREAM


def stream_head(grouping_id: int, schema: pa.Schema = _STREAM) -> bytes:
    """What comes before the chunks of a dimension: its id as 32-bit big-endian integer, and the schema."""
    return grouping_id.to_bytes(4, "big") + schema.serialize().to_pybytes()


def panel_chunks(panel: DataFrame) -> DataFrame:
    """(grouping_id, chunk, data): the panel as pieces of one Arrow stream per dimension.

    Made by the tasks that sort the panel, a piece per Arrow batch, so a panel of any size is exported whole
    and none of it passes through the driver. ``stream_head``, the pieces of a
    dimension by chunk, and an end mark are its stream; rows lie in the order of the panel. No rows, no pieces.
    """
    schema = _schema_of(panel)

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            groups = batch.column("grouping_id")
            for group in pc.unique(groups).to_pylist():
                part = batch.filter(pc.equal(groups, group)).select(schema.names).cast(schema)
                data = part.serialize().to_pybytes()
                yield pa.RecordBatch.from_pydict(
                    {"grouping_id": pa.array([group], pa.int32()), "chunk": pa.array([(task << 32) + n], pa.int64()), "data": pa.array([data], pa.binary())}
                )

    return ordered(panel.select("grouping_id", *schema.names)).mapInArrow(pack, CHUNK_SCHEMA)


def write_panel_streams(panel: DataFrame, path: str) -> None:
    """Store the pieces of the streams, one folder per dimension."""
    panel_chunks(panel).write.mode("overwrite").partitionBy("grouping_id").parquet(path)


def iterate_stream(chunks: DataFrame, grouping_id: int, schema: pa.Schema = _STREAM) -> Iterator[bytes]:
    """The stream of one dimension piece by piece, for a connection; the driver holds one partition at a time."""
    pieces = chunks.where(F.col("grouping_id") == grouping_id).orderBy("chunk").toLocalIterator()
    found = False
    for row in pieces:
        if not found:
            yield stream_head(grouping_id, schema)
        found = True
        yield bytes(row.data)
    if found:
        yield _END


def panel_streams(panel: DataFrame) -> dict[int, bytes]:
    """Arrow IPC stream per grouping id, each behind the id as 32-bit big-endian integer.

    All streams whole in the driver's memory, for panels cut to a limit; ``panel_chunks`` has no such bound. No
    rows, no streams.
    """
    streams: dict[int, bytes] = {}
    schema = _schema_of(panel)
    for row in panel_chunks(panel).orderBy("grouping_id", "chunk").collect():
        streams[row.grouping_id] = streams.get(row.grouping_id, stream_head(row.grouping_id, schema)) + bytes(row.data)
    return {group: data + _END for group, data in streams.items()}


def read_chunks(chunks: DataFrame, labelled: bool = False) -> DataFrame:
    """The panel rows in the pieces, read by the executors."""
    schema = _STREAM.append(pa.field("present", pa.string())) if labelled else _STREAM

    def unpack(batches):
        for batch in batches:
            for group, data in zip(batch.column("grouping_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = pa.ipc.read_record_batch(pa.py_buffer(data), schema)
                ids = pa.array([group] * part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["grouping_id", *schema.names])

    kind = T.StructType(list(PANEL_SCHEMA))
    return chunks.mapInArrow(unpack, kind.add("present", T.StringType()) if labelled else kind)
