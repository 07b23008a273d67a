"""Time series over a stream of events: running counts, or counts of closed periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetally.functions.clock import UNITS, trunc_column
from pagetally.session import exists


def stream_scale(events: DataFrame, unit: str) -> DataFrame:
    """(period, count) per unit as a running aggregate.

    Every event counts, however late; the state is one row per period.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit!r}")
    return events.groupBy(trunc_column(unit, F.col("timestamp")).alias("period")).agg(F.count("*").alias("count"))


def start_scale(counted: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the changed periods of every micro-batch; a repeated batch replaces itself."""

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


_UPDATES = "period timestamp_ntz, count long, batch long"


def _latest(updates: DataFrame) -> DataFrame:
    return updates.groupBy("period").agg(F.max_by("count", "batch").alias("count"))


def fold_scale(spark: SparkSession, path: str, folded: str, upto: int) -> None:
    """Keep the latest count of every period, as of batch ``upto``, as one directory below ``folded``.

    After it the update directories up to that batch are not needed any more.
    """
    updates = read_updates(spark, path, None if not exists(spark, folded) else folded, upto - 1)
    batch = _latest(updates.where(F.col("batch") <= upto))
    batch.coalesce(1).write.mode("overwrite").parquet(f"{folded.rstrip('/')}/batch={upto}")


def read_updates(spark: SparkSession, path: str, folded: str | None = None, upto: int | None = None) -> DataFrame:
    """Update rows; those up to the last fold (at most ``upto``) come from the fold."""
    updates = spark.read.schema(_UPDATES).parquet(path)
    if folded is None:
        return updates
    base = spark.read.schema(_UPDATES).parquet(folded)
    if upto is not None:
        base = base.where(F.col("batch") <= upto)
    last = base.agg(F.max("batch")).first()[0]
    if last is None:
        return updates
    return base.where(F.col("batch") == last).unionByName(updates.where(F.col("batch") > last))


def read_scale(spark: SparkSession, path: str, folded: str | None = None) -> DataFrame:
    """Latest count of every period, from the last fold and the updates after it."""
    return _latest(read_updates(spark, path, folded))


_COUNTS = "period timestamp_ntz, count long"
_LAST = "last timestamp_ntz"


def start_closed_scale(
    events: DataFrame, unit: str, path: str, checkpoint: str, delay: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Counts per period, each written once, when the period is closed.

    A period is closed when an event of ``delay`` after its end has come. The watermark is the
    latest event time of all batches before less the delay, as Spark's own; it is kept with
    the open periods, because rows behind it are wanted here and Spark would drop them. Each
    micro-batch is counted by period in one aggregation; then four small tables are written
    below ``path``, in directories named after the batch, so that a repeated batch replaces
    itself: ``closed`` (final counts), ``late`` (counts that came for closed periods),
    ``open`` (counts so far) and ``mark`` (latest event time). A batch reads ``open`` and ``mark`` of the batch
    before it and nothing else, so the state is one row per open period.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit!r}")
    root = path.rstrip("/")
    pause = F.expr(f"interval {delay}")

    def write_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        period = trunc_column(unit, F.col("timestamp")).alias("period")
        counted = batch.groupBy(period).agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("last")).persist()
        try:
            before = f"batch={number - 1}"
            known = number > 0
            if known and not exists(session, f"{root}/mark/{before}"):
                raise ValueError(f"{root} lacks the tables of batch {number - 1}: was the checkpoint made for another path?")
            none = session.createDataFrame([], _COUNTS)
            was_open = session.read.schema(_COUNTS).parquet(f"{root}/open/{before}") if known else none
            mark = session.read.schema(_LAST).parquet(f"{root}/mark/{before}").first()[0] if known else None
            latest = counted.agg(F.max("last")).first()[0]
            last = max((x for x in (mark, latest) if x is not None), default=None)

            def is_closed(moment) -> Column:
                """Whether the period ends at or before the watermark that a latest event time gives."""
                if moment is None:
                    return F.lit(False)
                end = F.col("period") + F.expr(f"interval 1 {unit}")
                return F.coalesce(end + pause <= F.lit(moment).cast("timestamp_ntz"), F.lit(False))

            new = counted.select("period", "count")
            late = new.where(is_closed(mark))
            current = was_open.unionByName(new.where(~is_closed(mark))).groupBy("period").agg(F.sum("count").alias("count"))
            tables = {
                "closed": current.where(is_closed(last)),
                "late": late,
                "open": current.where(~is_closed(last)),
                "mark": session.createDataFrame([(last,)], _LAST),
            }
            for name, table in tables.items():
                table.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            counted.unpersist()

    return (
        events.select("timestamp")
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def _batches(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(f"{_COUNTS}, batch long").parquet(f"{path.rstrip('/')}/{name}")


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    """Count of every closed period as it was when it closed; a period has one row and never changes."""
    return _batches(spark, path, "closed").select("period", "count")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """(batch, period, count) of events that came for closed periods."""
    return _batches(spark, path, "late").select("batch", "period", "count")


def read_open(spark: SparkSession, path: str) -> DataFrame:
    """Counts so far of the periods that are open after the last batch."""
    rows = _batches(spark, path, "open")
    marks = spark.read.schema(f"{_LAST}, batch long").parquet(f"{path.rstrip('/')}/mark")
    return rows.where(F.col("batch") == marks.agg(F.max("batch")).scalar()).select("period", "count")


def read_all_periods(spark: SparkSession, path: str) -> DataFrame:
    """Count of every period, of all events so far: closed counts, late ones and open ones together."""
    late = read_late(spark, path).drop("batch")
    parts = read_closed(spark, path).unionByName(late).unionByName(read_open(spark, path))
    return parts.groupBy("period").agg(F.sum("count").alias("count"))
