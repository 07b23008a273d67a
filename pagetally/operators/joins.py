"""Equi-joins that stay splittable at hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(rows: DataFrame, table: DataFrame, keys: Sequence[str] | Mapping[str, Column], how: str = "left") -> DataFrame:
    """Join on columns of the same name, or on the expressions over ``rows`` that ``keys`` gives for columns of ``table``.

    The result has the columns of ``rows`` and those of ``table`` that are no keys.

    No hint: Spark broadcasts a table that is small by its size. A large one is
    shuffled, and then AQE splits a key that holds many rows, but only where both
    sides are shuffled for the join itself. A table grouped by the key is not, it
    keeps the grouping's partitions. The second, redundant key makes Spark shuffle
    it again. Keys are compared as expressions and not first made columns of ``rows``: each such
    column would double what the optimizer infers about the ones it is made of.
    """
    named = keys if isinstance(keys, Mapping) else {key: F.col(key) for key in keys}
    own = {key: f"__join_{key}" for key in named}
    rest = [F.col(c) for c in table.columns if c not in named]
    again = F.hash(*[F.col(key) for key in named]).alias("__join_again")
    other = table.select(*[F.col(key).alias(name) for key, name in own.items()], again, *rest)
    tests = [named[key] == F.col(name) for key, name in own.items()]
    tests.append(F.hash(*named.values()) == F.col("__join_again"))
    return rows.join(other, reduce(and_, tests), how).drop(*own.values(), "__join_again")
