"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagetally.model import BEACON_SCHEMA
from pagetally.operators import ingest as ing
from pagetally.operators.lookups import Lookups
from pagetally.operators.registry import Registry
from pagetally.sources import lake

# Fixed value: longest wait before a batch is written.
DEFAULT_TRIGGER = {"processingTime": "5 seconds"}


def write_rejects(rejects: DataFrame, path: str, batch: str) -> None:
    """One directory per micro-batch, replaced when the batch is repeated."""
    rejects.write.mode("overwrite").partitionBy("instance").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Rejected beacons with reason and micro-batch number."""
    schema = T.StructType(list(BEACON_SCHEMA)).add("broken", "string").add("reason", "string").add("batch", "long")
    return spark.read.schema(schema).parquet(path)


class KeptRegistry:
    """A registry loader that keeps what it loaded until the version changes or the time is over.

    ``load`` reads the registry; ``version`` gives a token that changes with it, such as the
    label of the last load, and is asked on every call, so it must be cheap. Services and
    matchers are persisted, and read again where an executor is lost. Without ``version`` only the
    time counts.
    """

    def __init__(self, load: Callable[[], Registry], version: Callable[[], object] | None = None, seconds: float = 30.0):
        self.load, self.version, self.seconds = load, version, seconds
        self.kept: Registry | None = None
        self.token: object = None
        self.until = 0.0

    def __call__(self) -> Registry:
        token = self.version() if self.version else None
        if self.kept is None or token != self.token or time.monotonic() >= self.until:
            self.drop()
            loaded = self.load()
            self.kept = Registry(loaded.services.persist(), loaded.matchers.persist())
            self.token, self.until = token, time.monotonic() + self.seconds
        return self.kept

    def drop(self) -> None:
        """Forget what is kept; the next call loads anew."""
        if self.kept is not None:
            self.kept.services.unpersist()
            self.kept.matchers.unpersist()
        self.kept = None


def write_counted(rows: DataFrame, columns: list[str], events: str, rejects: str, batch: str, encoding: str) -> list[tuple]:
    """Write the events and rejects of ingested rows and tell their numbers: (reason, count).

    The rows are counted by the tasks that write them; nothing is read again. The reason of
    accepted rows is NULL, and zeros are included.
    """
    kept, left = Observation(), Observation()
    lake.write_events(ing.to_events(rows), events, batch, encoding, observed=kept)
    by_reason = [F.count(F.when(F.col("reason") == reason, F.lit(1))).alias(reason) for reason in ing.REASONS]
    write_rejects(ing.rejected(rows, columns).observe(left, *by_reason), rejects, batch)
    rejected = left.get
    return [(None, kept.get["rows"]), *((reason, rejected[reason]) for reason in ing.REASONS)]


METRICS_SCHEMA = "batch long, reason string, count long"


def write_metrics(spark: SparkSession, counts: list[tuple], path: str, batch: int) -> None:
    """The numbers of one micro-batch, a dozen rows, as one directory; a repeated batch replaces its own."""
    rows = spark.createDataFrame([(batch, *row) for row in counts], METRICS_SCHEMA).coalesce(1)
    rows.drop("batch").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(batch, reason, count): what every micro-batch accepted (reason NULL) and rejected by reason."""
    return spark.read.schema("reason string, count long, batch long").parquet(path).select("batch", "reason", "count")


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Accepted, rejected and received beacons of every micro-batch, batches without beacons included."""
    accepted = F.sum(F.when(F.col("reason").isNull(), F.col("count")).otherwise(0))
    received = F.sum("count")
    return metrics.groupBy("batch").agg(
        accepted.alias("accepted"), (received - accepted).alias("rejected"), received.alias("received")
    )


def start_ingest(
    beacons: DataFrame,
    events_path: str,
    rejects_path: str,
    checkpoint: str,
    load_registry: Callable[[], Registry],
    load_lookups: Callable[[], Lookups],
    trigger: dict | None = None,
    encoding: str = "struct",
    metrics_path: str | None = None,
) -> StreamingQuery:
    """Start the stream: accepted beacons to the event table, the rest to the rejects.

    Registry and lookups are loaded for every micro-batch, so a change is
    seen within one trigger; give a ``KeptRegistry`` to load it less often. With
    ``metrics_path`` the numbers of accepted and rejected beacons, counted while they are
    written, go to a table of their own. Each micro-batch writes to directories named after
    its number and replaces them when Spark repeats it, which makes the result
    exactly-once. The micro-batch is persisted because two writes read it; a lost
    executor only costs a recomputation from the source.
    """
    columns = beacons.columns

    def write_batch(batch: DataFrame, number: int) -> None:
        rows = ing.ingest(batch, load_registry(), load_lookups()).persist()
        try:
            counts = write_counted(rows, columns, events_path, rejects_path, str(number), encoding)
            if metrics_path is not None:
                write_metrics(batch.sparkSession, counts, metrics_path, number)
        finally:
            rows.unpersist()

    return (
        beacons.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )


def batch_progress(events: DataFrame) -> DataFrame:
    """Stored events per tenant and micro-batch, read from the event table."""
    return events.groupBy("instance", "batch").agg(F.count("*").alias("count"))


def batch_counts(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """Accepted, rejected and received beacons of every micro-batch, from the two tables.

    Complete however long the stream has run. A batch without beacons has no row.
    """
    batch = F.col("batch").cast("long").alias("batch")
    kept = events.select(batch, F.lit(1).alias("accepted"), F.lit(0).alias("rejected"))
    both = kept.unionByName(rejects.select(batch, F.lit(0).alias("accepted"), F.lit(1).alias("rejected")))
    sums = both.groupBy("batch").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return sums.withColumn("received", F.col("accepted") + F.col("rejected"))
