"""Membership filters with the empty-string rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column


def where_in(column: Column, values: Sequence[str]) -> Column:
    """``column IN values``; one ``""`` among the values stands for NULL.

    A stored empty string is not matched by that ``""``.
    """
    rest = list(values)
    if "" not in rest:
        return column.isin(rest)
    rest.remove("")
    return column.isin(rest) | column.isNull() if rest else column.isNull()
