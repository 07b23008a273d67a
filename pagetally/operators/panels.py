"""The thirteen-dimension report: counts per value, largest count, top N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import labels
from pagetally.model import DEFAULT_LIMIT, DIMENSIONS, GROUPING_IDS
from pagetally.session import written


def dimension_values(page_views: DataFrame, *extra: Column, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """One row (grouping_id, value) per page view and dimension."""
    entries = [
        F.struct(F.lit(GROUPING_IDS[d]).alias("grouping_id"), F.col(d).alias("value")) for d in dimensions
    ]
    return page_views.select(*extra, F.inline(F.array(*entries)))


def panel_counts(page_views: DataFrame, form: str = "explode", dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(grouping_id, value, count) for all values of the dimensions, NULL included.

    ``explode`` keeps the shuffle key down to two columns and counts before the
    shuffle, so one value holding most rows costs one row per task.
    ``grouping_sets`` is the textbook form with thirteen key columns.
    """
    if form == "explode":
        values = dimension_values(page_views, dimensions=dimensions)
        return values.groupBy("grouping_id", "value").agg(F.count("*").alias("count"))
    if form != "grouping_sets":
        raise ValueError(f"unknown form: {form!r}")
    columns = [F.col(d) for d in dimensions]
    counted = page_views.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().cast("int").alias("grouping_id"), F.count("*").alias("count")
    )
    value = F.coalesce(*[F.when(F.col("grouping_id") == GROUPING_IDS[d], F.col(d)) for d in dimensions])
    return counted.select("grouping_id", value.alias("value"), "count")


def top_values(counts: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``limit`` values of each dimension by count; ties go by value, NULL first.

    Each task cuts its own rows to the limit before they are shuffled by
    grouping_id, so no task ever sees a whole dimension.
    """
    order = Window.partitionBy("grouping_id").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    ranked = counts.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= limit).drop("position")


def count_thresholds(counts: DataFrame, limit: int) -> DataFrame:
    """(grouping_id, cut, room): the count at which a dimension reaches the limit, and how many values with it have room.

    A histogram of the counts tells; it has a row per different count, which for n page views
    are at most the root of 2 n. A dimension with fewer values than the limit has no row.
    """
    histogram = counts.groupBy("grouping_id", "count").agg(F.count(F.lit(1)).alias("n"))
    larger = Window.partitionBy("grouping_id").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    above = histogram.withColumn("above", F.coalesce(F.sum("n").over(larger), F.lit(0)))
    reached = above.where((F.col("above") < limit) & (F.col("above") + F.col("n") >= limit))
    return reached.select("grouping_id", F.col("count").alias("cut"), (F.lit(limit) - F.col("above")).alias("room"))


def top_values_by_threshold(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of ``top_values``, for limits so large that one task must not rank a dimension.

    Values above the threshold count of their dimension are kept by a filter. Those at it are
    dealt to tasks by ranges of values and written; whole ranges are kept by their sizes, and
    only the range in which the room ends is ranked. ``counts`` is read several times: pass a
    stored table.
    """
    # one row per dimension, hence the fixed broadcast
    cuts = F.broadcast(written(count_thresholds(counts, limit), "thresholds"))
    marked = counts.join(cuts, "grouping_id", "left")
    above = marked.where(F.col("cut").isNull() | (F.col("count") > F.col("cut"))).select(counts.columns)
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = marked.where(F.col("count") == F.col("cut"))
    ranged = ties.repartitionByRange(tasks, "grouping_id", F.asc_nulls_first("value")).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ties")

    sizes = ranged.groupBy("grouping_id", "range", "room").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("grouping_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    sizes = sizes.withColumn("left", left).where("left > 0").select("grouping_id", "range", "n", "left")
    held = ranged.drop("room").join(sizes, ["grouping_id", "range"])
    order = Window.partitionBy("grouping_id", "range").orderBy(F.asc_nulls_first("value"))
    border = held.where("left < n").withColumn("position", F.row_number().over(order)).where("position <= left")
    whole = held.where("left >= n")
    return above.unionByName(whole.select(counts.columns)).unionByName(border.select(counts.columns))


def with_max(top: DataFrame) -> DataFrame:
    """Largest count of each dimension, for rows already cut by ``top_values``.

    The cut keeps the largest count, so this equals the maximum before the cut.
    """
    return top.withColumn("max", F.max("count").over(Window.partitionBy("grouping_id")))


def with_max_uncut(counts: DataFrame) -> DataFrame:
    """Largest count of each dimension, for counts of any size.

    Thirteen maxima are joined back; no dimension is gathered in one task.
    """
    # never more than one row per dimension, hence the fixed broadcast
    return counts.join(F.broadcast(_maxima(counts)), "grouping_id")


def _maxima(counts: DataFrame) -> DataFrame:
    return counts.groupBy("grouping_id").agg(F.max("count").alias("max"))


def ordered(rows: DataFrame) -> DataFrame:
    """Dimension by dimension, largest count first; ties by value, NULL first."""
    return rows.orderBy("grouping_id", F.desc("count"), F.asc_nulls_first("value"))


def panel(
    page_views: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    form: str = "explode",
    dimensions: Sequence[str] = DIMENSIONS,
    selection: str = "window",
) -> DataFrame:
    """The report (grouping_id, value, count, max), ordered; ``limit=None`` keeps every value.

    ``selection="threshold"`` gives the same rows by ``top_values_by_threshold``, for limits of a
    million and more; it writes the counts to a work folder.

    Of the page views only the columns of ``dimensions`` are read. The grouping-sets
    form knows its ids by all thirteen.
    """
    if form == "grouping_sets" and len(dimensions) != len(DIMENSIONS):
        raise ValueError("the grouping-sets form has all dimensions")
    counts = panel_counts(page_views, form, dimensions)
    if selection not in ("window", "threshold"):
        raise ValueError(f"unknown selection: {selection!r}")
    if limit is None:
        rows = with_max_uncut(counts)
    elif selection == "window":
        rows = with_max(top_values(counts, limit))
    else:
        counts = written(counts, "counts")
        rows = top_values_by_threshold(counts, limit).join(F.broadcast(_maxima(counts)), "grouping_id")
    return ordered(rows.select("grouping_id", "value", "count", "max"))


def panel_of(panel_rows: DataFrame, dimension: str) -> DataFrame:
    """The rows of one dimension, without the id column."""
    return panel_rows.where(F.col("grouping_id") == GROUPING_IDS[dimension]).drop("grouping_id")


def present(panel_rows: DataFrame, territories: DataFrame | None = None) -> DataFrame:
    """Add the display label ``present``; ``territories`` has (country_code, name)."""
    if territories is None:
        return panel_rows.withColumn("present", labels.present(F.col("grouping_id"), F.col("value")))
    names = territories.groupBy(F.col("country_code").alias("value")).agg(F.min("name").alias("territory"))
    labelled = labels.present(F.col("grouping_id"), F.col("value"), F.col("territory"))
    joined = panel_rows.join(names, "value", "left")
    return ordered(joined.select(*[F.col(c) for c in panel_rows.columns], labelled.alias("present")))
