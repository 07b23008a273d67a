"""Vector code compression: product codes learned with per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.llm.common import free_name, stored
from pagetally.operators.joins import join_on

SCALE = 4096
LIMB = 40  # bits of a sum that travel as one number, so that adding them up cannot overflow
MOST_LONG = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite components."""

    def bad(x: Column) -> Column:
        x = x.cast("double") * SCALE
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, bad))


def spans(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal length; where they do not come out even, the first ones have one more."""
    edges = np.cumsum([0, *(len(part) for part in np.array_split(np.arange(dim), parts))])
    return [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where all distances fit into them, else Python's."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    reach = np.abs(scaled).max(initial=0)
    if reach <= safe(vectors.shape[1]):
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(scaled)


def safe(dim: int) -> int:
    """Components up to this size have squared distances below 2^62."""
    return int(np.sqrt((1 << 60) // max(dim, 1)))


@dataclass(frozen=True)
class Block:
    """Vectors as codes into one dictionary of distinct integers per dimension."""

    values: np.ndarray
    dictionaries: list[np.ndarray]
    codes: list[np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        values = whole(vectors)
        pairs = [_distinct(column) for column in values.T]
        return cls(values, [d for d, _ in pairs], [c for _, c in pairs])

    def distances(self, book: np.ndarray, part: slice) -> np.ndarray:
        """Squared distance of each vector's part to each entry.

        For each dimension the squared differences of its distinct integers to all entries
        are one small table; a vector's distances are sums of rows gathered from the tables.
        """
        total = np.zeros((len(self.values), len(book)), dtype=np.result_type(self.values, book))
        for j in range(part.start, part.stop):
            table = (self.dictionaries[j][:, None] - book[None, :, j]) ** 2
            total += table[self.codes[j]]
        return total

    def assign(self, book: np.ndarray, parts: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances), one column per part; ties go to the lower index."""
        if self.values.dtype != object and all(abs(x) <= safe(book.shape[1]) for x in book.flat):
            book = book.astype(np.int64)
        far = [self.distances(book, part) for part in parts]
        entries = np.stack([np.argmin(d, axis=1) for d in far], axis=1)
        least = [d[np.arange(len(d)), entries[:, i]] for i, d in enumerate(far)]
        return entries, np.stack(least, axis=1)


def _distinct(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them)."""
    if column.dtype != object and len(column):
        low, high = int(column.min()), int(column.max())
        if high - low < 8 * len(column) + 1024:  # dense: counting is cheaper than sorting
            shifted = column - low
            there = np.flatnonzero(np.bincount(shifted))
            place = np.empty(high - low + 1, dtype=np.int64)
            place[there] = np.arange(len(there))
            return there + low, place[shifted]
    return np.unique(column, return_inverse=True)


def blocks(batches: Iterator[pa.RecordBatch], vec_col: str, dim: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Record batches cut into pieces of bounded size, with their vectors."""
    rows = max(1, (1 << 20) // max(dim, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            flat = piece.column(vec_col).flatten().to_numpy(zero_copy_only=False)
            yield piece, Block.of(flat.reshape(piece.num_rows, dim))


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    sign, number, place = (-1 if number < 0 else 1), abs(number), 0
    while number or not place:
        yield place, sign * (number & ((1 << LIMB) - 1))
        number >>= LIMB
        place += 1


def _round(kept: DataFrame, vec_col: str, book: np.ndarray, parts: list[slice]) -> np.ndarray:
    """The codebook after one round: every entry the floored mean of the parts next to it."""
    dim, entries = book.shape[1], len(book)

    def add_up(batches):
        sums = np.zeros((entries, dim), dtype=object)
        counts = np.zeros((entries, len(parts)), dtype=np.int64)
        for _, block in blocks(batches, vec_col, dim):
            nearest, _ = block.assign(book, parts)
            for i, part in enumerate(parts):
                counts[:, i] += np.bincount(nearest[:, i], minlength=entries)
                for j in range(part.start, part.stop):
                    column = block.values[:, j]
                    if column.dtype == object:
                        np.add.at(sums[:, j], nearest[:, i], column)
                    else:  # below 2^53 in a piece of 2^20 numbers of at most 2^30
                        added = np.bincount(nearest[:, i], weights=column, minlength=entries)
                        sums[:, j] += added.astype(np.int64).astype(object)
        rows = [
            (k, j, place, limb, int(counts[k, i]))
            for i, part in enumerate(parts) for j in range(part.start, part.stop) for k in range(entries) if counts[k, i]
            for place, limb in _limbs(int(sums[k, j]))
        ]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUMS.types, strict=True)], schema=_SUMS)

    partial = kept.select(vec_col).mapInArrow(add_up, "entry int, dim int, place int, limb long, n long")
    added = partial.groupBy("entry", "dim", "place").agg(F.sum("limb").alias("limb"), F.sum("n").alias("n")).collect()
    sums, counts = {}, {}
    for row in added:
        at = row.entry, row.dim
        sums[at] = sums.get(at, 0) + (row.limb << (LIMB * row.place))
        counts[at] = max(counts.get(at, 0), row.n)  # every task gives a count with its lowest limb
    after = book.copy()
    for at, total in sums.items():
        after[at] = total // counts[at]
    return after


_SUMS = pa.schema([("entry", pa.int32()), ("dim", pa.int32()), ("place", pa.int32()), ("limb", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class Compressed:
    """``rows``: the kept rows with ``code`` (hexadecimal) and ``error``; ``codebook``: entry x dimension, whole numbers."""

    rows: DataFrame
    codebook: np.ndarray
    parts: list[slice]

    def digest(self) -> str:
        """sha256 of all components by part, entry and place within the part."""
        numbers = (str(x) for part in self.parts for entry in self.codebook for x in entry[part])
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> Compressed:
    """Replace every vector by ``parts`` indexes into codebooks learned from all vectors.

    Components become floor(4096 x). The codebooks start from the ``entries`` least
    identifiers; each round assigns all parts and takes floored means; sums are exact whole
    numbers of any size. Spark adds up one row per task, entry and dimension; the driver holds
    the codebook, ``entries`` numbers a dimension.

    Vectors that are null or hold null or non-finite components take no part (nor do doubles
    whose 4096-fold is infinite). The length is that of the least kept identifier's vector, and
    vectors of another length take no part. Null identifiers come last; rows that repeat an
    identifier are ordered by their vectors. With fewer rows than entries the codebooks are
    smaller, and an entry that nothing is next to stays as it is. Lengths that the parts do not
    divide make the first parts one longer; parts of no length have index 0. Errors beyond
    63 bits are given as the largest long. Other columns are kept; empty tables give no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits")
    numbers = F.col(vec_col).cast("array<double>")
    kept = kept_vectors(vectors, vec_col)
    first = kept.select(id_col, numbers.alias("v")).orderBy(F.asc_nulls_last(id_col), "v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    kept = stored(kept.where(F.size(vec_col) == dim), "vectors")
    start = kept.select(id_col, numbers.alias("v")).orderBy(F.asc_nulls_last(id_col), "v").limit(entries).collect()
    cut = spans(dim, parts)
    exact = np.frompyfunc(int, 1, 1)
    book = exact(np.floor(np.array([row.v for row in start], dtype=np.float64).reshape(len(start), dim) * SCALE))
    book = book.reshape(len(start), dim).astype(object)
    for _ in range(rounds if start else 0):
        book = _round(kept, vec_col, book, cut)

    def encode(batches):
        for piece, block in blocks(batches, vec_col, dim):
            nearest, far = block.assign(book, cut)
            codes = ["".join(f"{k:02x}" for k in row) for row in nearest.tolist()]
            errors = [min(sum(map(int, row)), MOST_LONG) for row in far.tolist()]
            arrays = [*piece.columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, code, error])

    code, error = free_name(vectors, "code"), free_name(vectors, "error")
    schema = T.StructType([*kept.schema, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    return Compressed(stored(kept.mapInArrow(encode, schema), "vector-codes"), book, cut)


def with_group_error(rows: DataFrame, group: str, error: str = "error", name: str = "group_error") -> DataFrame:
    """The error added up over equal values of ``group``, nulls together; at most the largest long.

    Added up before the shuffle and joined back, so no group is gathered in one task.
    """
    known, value = F.col(group).isNotNull(), F.coalesce(F.col(group).cast("string"), F.lit(""))
    name, known_, value_ = (free_name(rows, n) for n in (name, "__known", "__value"))
    keyed = rows.withColumns({known_: known, value_: value})
    total = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)"))
    sums = keyed.groupBy(known_, value_).agg(total.cast("long").alias(name))
    return join_on(keyed, sums, [known_, value_]).drop(known_, value_)
