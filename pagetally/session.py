"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on UTC wall clocks. The adaptive settings let Spark size
# partitions and split hot keys at run time. The JVM never compiles a method above
# 8000 bytes, so a stage whose fused code is larger is better run unfused.
# Variants are stored in typed parts, and a query reads those of the properties it names.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
}


_test_roots: dict[str, str] = {}


# Shuffle bytes one task should get.
PARTITION_BYTES = 128 * 1024 * 1024

# Tasks a core that list the directories of a table.
LISTING_TASKS = 4


def configure(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to an existing session.

    Directories of a table are listed by a few tasks a core: by default Spark makes a task
    of every few of them, and starting those takes ten times as long as the listing.

    ``shuffle_bytes``, the size of the largest shuffle to expect, sets the number
    of shuffle partitions; without it the session's own number stays.
    """
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    listing = spark.sparkContext.defaultParallelism * LISTING_TASKS
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(listing))
    if shuffle_bytes is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-shuffle_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    return spark


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whichever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A work folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors share one machine, a temporary
    folder may take its place; elsewhere a missing setting is an error. Folders are kept apart by application id, so a rerun inside one
    application overwrites its own data and nobody else's.
    """
    application = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _test_roots:
            _test_roots[application] = tempfile.mkdtemp(prefix="pagetally-")
        root = _test_roots[application]
    return f"{root.rstrip('/')}/pagetally/{application}/{name}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a work folder of its own and read back: computed once, whatever reads it."""
    path = shared_dir(frame.sparkSession, f"work/{name}-{uuid.uuid4().hex[:12]}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
