"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import stored


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    pairs = _both(links)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) of each node that has a link; root is its component's smallest node.

    ``links`` has the comparable columns a and b. Large-star and small-star steps take
    turns until the links no longer change; the number of steps grows with the logarithm
    of the nodes. Each step keeps its links in the shared folder. A node with very many
    links meets them in a join whose large side Spark can split, never in one group.
    Links of a node to itself or with a null are left out; no links give no rows.
    """
    now = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    while True:
        stars = stored(_large_star(now).distinct(), "large-star")
        now = stored(_small_star(stars).distinct(), "small-star")
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
