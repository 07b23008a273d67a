"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import free_name, id_text, stored

MOST_RATE = 200.0  # a larger mean is the sum of several equal ones


def _uniform(text: Column) -> Column:
    """Hash-seeded number in [0, 1): the first 52 bits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cumulative(rate: Column) -> Column:
    """P(X <= k), k = 0, 1, ..., of the Poisson distribution, beyond any 52-bit number."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 40).cast("int"))
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def add(state, k):
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(steps, start, add, lambda state: state["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its share of the mixture.

    ``weights`` gives the target shares, in any unit; sources it lacks get none. Without it
    all sources, the null one included, weigh the same. ``size`` is the mean number of
    documents of the mixture; by default as many as there are. Negative weights count as 0.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(max(w, 0))))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = counts.select("source", "n", weight.alias("w"))
    weighed = stored(weighed, "source-counts")
    total = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    target = (total.n or 0) if size is None else size
    rate = F.col("w") * float(target) / (F.lit(float(total.w)) * F.col("n")) if total.w else F.lit(0.0)
    return weighed.select("source", rate.alias("rate"))


def poisson_mixture(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    size: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
) -> DataFrame:
    """Documents repeated to the target weights, in random order.

    A row's number of copies is the inverse Poisson distribution, with its source's rate as
    mean, at a number hashed from seed and identifier: rerun or recomputed, it is the same.
    ``copy`` counts a row's copies from 0 and ``shuffle_key`` is hashed from seed,
    identifier and copy; rows are dealt to tasks by that key and lie in its order. So every
    copy is placed by chance, and no source gathers in one task.

    Rows that repeat an identifier get equal counts and keys. Null identifiers hash as the
    empty text. Null sources are a source of their own. Empty tables give no rows. Names
    already taken get underscores in front.
    """
    names = "copy", "shuffle_key", "rate", "_mixed", "_parts", "_cdf", "_copies"
    copy, key, rate, mixed, n_parts, cdf, copies_ = (free_name(docs, n) for n in names)
    rates = source_rates(docs, weights, size)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    tables = rates.select(F.col("source").alias(mixed), parts.alias(n_parts), (F.col("rate") / parts).alias(rate))
    # written, so that Spark knows the table's size and broadcasts it only if it is small
    tables = stored(tables.withColumn(cdf, _cumulative(F.col(rate))).drop(rate), "source-rates")
    joined = docs.join(tables, docs["source"].eqNullSafe(F.col(mixed)))
    name = F.concat_ws(":", F.lit(str(seed)), id_text(id_col))
    # copies of one part: the probabilities that do not reach above the hashed number
    drawn = F.transform(
        F.sequence(F.lit(0), F.col(n_parts) - 1),
        lambda p: F.size(F.filter(cdf, lambda c: c <= _uniform(F.concat_ws(":", name, p.cast("string"))))),
    )
    count = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    counted = joined.withColumn(copies_, count).where(F.col(copies_) > 0).drop(mixed, n_parts, cdf)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies_) - 1))).drop(copies_)
    keyed = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit("order"), name, F.col(copy).cast("string"))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, key).sortWithinPartitions(key, id_col)
