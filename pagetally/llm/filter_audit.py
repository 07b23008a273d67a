"""Filter interaction audit: forward-backward path counts over the lattice of filter sets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetally.llm.common import WORD_GAP, stored

MOST_FILTERS = 8  # their orders are 40,320

COPY = None  # in place of a condition: the text is that of a smaller identifier


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each set of applied filters, and orders that leave it for the full set.

    Sets are bit masks. Forward counts add up over the filters that can have come last,
    backward counts over those that can come next.
    """
    size = 1 << n
    forward, backward = [1] + [0] * (size - 1), [0] * (size - 1) + [1]
    for state in range(size):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(size)):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """The edges (state, filter, paths): ``paths`` orders apply ``filter`` right after the set ``state``."""
    forward, backward = path_counts(n)
    edges = [
        (s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1
    ]
    return spark.createDataFrame(edges, "state int, filter int, paths long")


def orders(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, state, filter): the edges that each order of the filters passes."""
    rows = []
    for order in permutations(range(len(names))):
        label, state = "".join(names[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((label, step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def quality_filters(text: Column) -> dict[str, Column | None]:
    """Conditions under which a text fails: too short, too repetitive, too many capitals, odd characters, a copy."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals.cast("long") > 3 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
        "E": COPY,
    }


def failures(docs: DataFrame, outcomes: DataFrame, filters: dict[str, Column | None], id_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, one count for each outcome): documents by the set of filters they fail.

    ``outcomes`` has one row per identifier. Counted before every shuffle, so copies of
    a text, whatever their number, cost a row per task; a null identifier joins nothing and
    is spread by its text.
    """
    marks = [c for c in outcomes.columns if c != "id"]
    mask = F.lit(0)
    for f, failed in enumerate(filters.values()):
        if failed is not COPY:
            mask = mask + F.when(failed, F.lit(1 << f)).otherwise(F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5("text")).alias("digest"),
        mask.alias("mask"),
    )
    copies = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    known = outcomes.where(F.col("id").isNotNull()).withColumn("salt", F.lit(0).cast("long"))
    marked = copies.withColumn("salt", salt).join(known, ["id", "salt"], "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in marks})

    # of the rows that are alike but for their identifier: how many, and how many have the least one
    held = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    alike = marked.groupBy("digest", "part", "mask", *marks).agg(
        F.sum("n").alias("n"),
        F.min(held).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    at_least = F.when(F.col("least") == F.col("first.id"), F.col("first.n")).otherwise(F.lit(0))
    alike = alike.withColumn("least", least).withColumn("passed", F.col("nameless") + at_least)
    bit = sum(1 << f for f, failed in enumerate(filters.values()) if failed is COPY)
    split = F.array(
        F.struct(F.col("mask"), F.col("passed").alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("passed")).alias("n")),
    )
    told = alike.select("part", *marks, F.inline(split)) if bit else alike.select("part", *marks, "mask", "n")
    sums = [F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in marks]
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def edge_removals(spark: SparkSession, counts: DataFrame, n: int, marks: Sequence[str]) -> DataFrame:
    """Every edge of the lattice in every part, with what its filter removes there.

    ``kept`` after it, ``removed`` by it and of these each mark, ``redundant`` (failing its
    filter, removed before), ``unique_fails`` (failing nothing else), and ``shapley``: the
    removals over all orders, each edge weighed by the orders that pass it.
    """
    masks = range(1 << n)
    # which documents an edge removes or keeps depends on their mask alone
    roles = [
        (s, f, m, bool(m >> f & 1 and not m & s), not m & (s | 1 << f), bool(m >> f & 1 and m & s), m == 1 << f)
        for s in masks for f in range(n) if not s >> f & 1 for m in masks
    ]
    schema = "state int, filter int, mask int, is_removed boolean, is_kept boolean, is_redundant boolean, is_unique boolean"
    role = F.broadcast(spark.createDataFrame(roles, schema))

    def total(flag: str, value: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col(value))), F.lit(0))

    # at most 2^n masks a part meet their roles; an edge whose filter touches none of them has zeros
    sums = counts.join(role, "mask").groupBy("part", "state", "filter").agg(
        total("is_kept").alias("kept"),
        total("is_removed").alias("removed"),
        total("is_redundant").alias("redundant"),
        total("is_unique").alias("unique_fails"),
        *[total("is_removed", c).alias(f"{c}_lost") for c in marks],
    )
    weighed = sums.join(F.broadcast(lattice(spark, n)), ["state", "filter"])
    shapley = weighed.groupBy("part", "filter").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    return weighed.drop("paths").join(shapley, ["part", "filter"])


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column | None] | None = None,
    outcomes: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    part_col: str = "lang",
) -> DataFrame:
    """What each filter removes at each step of every order of the filters, by part.

    ``filters`` maps a one-character name to the condition (over ``docs``) under which a document
    fails, or to ``COPY``: its text is that of a smaller identifier anywhere in the table. By
    default ``quality_filters``. ``outcomes`` maps a name to a condition over ``labels``; a
    document has it if any label row of its identifier does. Documents are counted once, by
    part and set of failed filters; what follows reads those counts, at most 2^n a part:
    forward and backward path counts weigh every edge of the lattice of filter sets, and each
    step of an order is one of the same edges. At most eight filters.

    Null texts are empty and null conditions do not fail. Null parts are the empty one. A
    null identifier is no copy, has no copies and no labels; rows that repeat an
    identifier and its text all pass as the first of it. Empty tables give no rows.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    filters = quality_filters(F.col("text")) if filters is None else filters
    outcomes = outcomes if outcomes is not None else {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    names, n = list(filters), len(filters)
    if not 1 <= n <= MOST_FILTERS or any(len(name) != 1 for name in names):
        raise ValueError(f"one to {MOST_FILTERS} filters with names of one character")
    spark = docs.sparkSession
    told = labels.select(F.col(id_col).alias("id"), *[F.coalesce(c, F.lit(False)).alias(name) for name, c in outcomes.items()])
    told = told.groupBy("id").agg(*[F.max(name).alias(name) for name in outcomes])
    # read by every sum below, and at most 2^n rows a part
    counts = stored(failures(docs, told, filters, id_col, part_col), "filter-failures")
    edges = edge_removals(spark, counts, n, list(outcomes))
    steps = F.broadcast(orders(spark, names))
    rows = edges.join(steps, ["state", "filter"])
    measures = ["kept", "removed", "redundant", "unique_fails", *[f"{o}_lost" for o in outcomes], "shapley"]
    return rows.select("part", "filter_order", "step", *measures)
