"""An inverted index of rules by a piece of text that whatever they match must contain.

Rules and texts meet in an equi-join on that piece, and only the pairs found are tested.
A rule without any such text has the piece '', which every text has too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions.literals import PIECE, pieces
from pagetally.operators.joins import join_on


def with_piece(rules: DataFrame, literal: Column, scope: Sequence[str] = ()) -> DataFrame:
    """Rules with ``piece``: the piece of their literal that fewest rules of the same scope have.

    So rules that share most of their text, such as a domain, are told apart by the rest.
    """
    own = rules.columns
    spread = rules.select("*", F.explode_outer(pieces(literal)).alias("piece"))
    counted = spread.groupBy(*scope, "piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = F.coalesce(F.min(F.struct("__n", "piece"))["piece"], F.lit(""))
    return join_on(spread, counted, [*scope, "piece"]).groupBy(*own).agg(rarest.alias("piece"))


def local_pieces(literals: Sequence[str]) -> list[str]:
    """The same choice for a short list that the driver has anyway."""
    own = [{text[i : i + PIECE] for i in range(len(text) - PIECE + 1)} for text in map(str.lower, literals)]
    counts = Counter(piece for found in own for piece in found)
    return [min(found, key=lambda piece: (counts[piece], piece), default="") for found in own]


def with_pieces(rows: DataFrame, text: Column, *more: Column) -> DataFrame:
    """One row per piece of the text, and one with ''; ``more`` are arrays of further keys."""
    return rows.select("*", F.explode(F.concat(F.array(F.lit("")), pieces(text), *more)).alias("piece"))
