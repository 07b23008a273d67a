"""Labelled rows for a classifier, and the scores of whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import free_name, held_out, id_text, texts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, id_col: str, text_col: str
) -> list[tuple[bytes, int]]:
    """At most ``bound`` (text, label) rows, picked by a hash of the identifier.

    ``keep`` is a condition on the identifier. Where labels of one identifier differ, the
    larger counts; null labels and identifiers do not; null texts are empty. Of several
    documents with one identifier any one, the smallest text, is taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(bound)
    texts_ = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts_.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = rows.orderBy("id").collect()
    return [(row.text.encode("utf-8"), row.label) for row in found]


def with_score(docs: DataFrame, text_col: str, name: str, score) -> DataFrame:
    """``docs`` with a score of each whole text; ``score`` takes bytes."""

    def scan(batches):
        for batch in batches:
            values = np.fromiter((score(t) for t in texts(batch, text_col)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{schema}, `{name}` double")


def report(docs: DataFrame, score, folds: int, fold: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """id, held_out, score, predicted of every row."""
    narrow = docs.select(id_col, F.col(text_col).alias(free_name(docs.select(id_col), "text")))
    scored = with_score(narrow, narrow.columns[1], free_name(narrow, "score"), score)
    return scored.select(
        id_col,
        F.coalesce(held_out(id_col, folds, fold), F.lit(False)).alias("held_out"),
        F.col(scored.columns[-1]).alias("score"),
        (F.col(scored.columns[-1]) >= threshold).cast("int").alias("predicted"),
    )


__all__ = ["held_out", "id_text", "labelled_sample", "report", "with_score"]
