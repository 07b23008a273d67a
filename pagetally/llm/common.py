"""Helpers that several operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.session import shared_dir

# Words of the operators: what stands between ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    Cuts the lineage: what follows never repeats the work above, also when executors
    are lost. Shuffle files of the write are no longer needed once the table is
    there, so Spark removes them at its end.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        frame.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove a table that ``stored`` wrote and nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        if "/llm/" in file:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all work tables of this application; results read before are gone with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "llm"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(column: str) -> Column:
    """An identifier as text; a missing one is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the identifier as text falls into the held-out fold."""
    return F.crc32(id_text(column).cast("binary")) % folds == fold


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, one by one; a null is an empty text."""
    values = batch.column(column)
    for start in range(0, len(values), 200):  # few at once: a copy of the whole column is large
        for value in values.slice(start, 200).cast(pa.large_binary()):
            yield value.as_py() or b""


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0..n-1, the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
