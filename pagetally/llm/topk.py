"""Exact inner-product search: long vectors first, pruned by bounds on rotated partial sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import stored

SCALE = 256  # fixed-point steps to one
GROUP_ROWS = 8192  # candidates that one task holds
BLOCK_ROWS = 512  # candidates compared at once
SAMPLE_ROWS = 4096  # vectors that the rotation is fitted on
SEED_ROWS = 2048  # longest vectors that give each query its first threshold
WHOLE = 2.0**62  # scores that may be larger are summed as Python integers
TOP = (1 << 63) - 1  # larger scores are given as this, smaller than its negative as that


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row_no, id, dim, ints, norm): valid vectors, components as floor(256 x), whole numbers in doubles.

    A double from 2^52 on is whole already, so these are exact at any size.
    """
    x = F.col(vector_col)
    scaled = lambda v: v.cast("double") * SCALE
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(scaled(v)) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < 2.0**52, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    valid = F.col(id_col).isNotNull() & x.isNotNull() & finite & (F.size(x) > 0)
    rows = vectors.where(valid).select(F.col(id_col).cast("long").alias("id"), ints.alias("ints"))
    square = F.aggregate("ints", F.lit(0.0), lambda s, v: s + v * v)
    return rows.select(
        F.monotonically_increasing_id().alias("row_no"), "id", F.size("ints").alias("dim"), "ints", F.sqrt(square).alias("norm")
    )


def rotations(vectors: DataFrame, sample: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """For each length, the right singular vectors of a bounded sample.

    They put most of an inner product into its first terms. Any rotation gives the same
    results; lengths outside the sample keep their own axes.
    """
    rows = vectors.orderBy(F.xxhash64("row_no"), "row_no").limit(sample).select("dim", "ints").collect()
    by_dim: dict[int, list] = {}
    for row in rows:
        by_dim.setdefault(row.dim, []).append(row.ints)
    scaled = {d: np.array(v) / max(1.0, np.abs(v).max()) for d, v in by_dim.items()}
    return {d: np.linalg.svd(v, full_matrices=True)[2].T for d, v in scaled.items()}


def _turn(ints: np.ndarray, rotation: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, lengths, lengths of what is left after ``head`` terms).

    Vectors too long for a double have infinite lengths, which prune nothing.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        turned = ints @ rotation
        norm, rest = np.linalg.norm(turned, axis=1), np.linalg.norm(turned[:, head:], axis=1)
    far = ~np.isfinite(norm)
    turned[far], norm[far], rest[far] = 0.0, np.inf, np.inf
    return turned, norm, rest


def _longs(ints: np.ndarray) -> np.ndarray:
    """As 64-bit integers; those that do not fit are not looked at, but for products with zeros."""
    with np.errstate(invalid="ignore"):
        return ints.astype(np.int64)


def _long_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as Python integers."""
    out = np.empty(len(a), object)
    for i in range(len(a)):
        out[i] = sum(int(x) * int(y) for x, y in zip(a[i], b[i], strict=True))
    return out


def _sortable(n: int) -> bytes | None:
    """Bytes in the order of the numbers of one sign; none for what fits a long."""
    if abs(n) < TOP:
        return None
    body = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    raw = len(body).to_bytes(2, "big") + body
    return raw if n > 0 else bytes(255 - x for x in raw)


class Group:
    """Candidates in order of falling length, rotated, with the lengths of what is left."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, ints: np.ndarray, rotation: np.ndarray | None):
        self.rotation = np.eye(ints.shape[1]) if rotation is None else rotation
        self.head = max(1, ints.shape[1] // 4)
        turned, norm, rest = _turn(ints, self.rotation, self.head)
        order = np.argsort(-norm, kind="stable")
        self.rows, self.ids, self.ints = rows[order], ids[order], ints[order]
        self.longs = _longs(self.ints)
        self.turned, self.norm, self.rest = turned[order], norm[order], rest[order]

    def search(self, rows: np.ndarray, ints: np.ndarray, least: np.ndarray, k: int):
        """(query, id, score) arrays: up to k best of each query that reach ``least``."""
        turned, norm, rest = _turn(ints, self.rotation, self.head)
        least, longs = least.copy(), _longs(ints)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for start in range(0, len(self.ids), BLOCK_ROWS):
            block = slice(start, start + BLOCK_ROWS)
            # infinite lengths may give NaN, which must count as within reach
            with np.errstate(over="ignore", invalid="ignore"):
                longest = norm * self.norm[start]
                open_ = np.flatnonzero(~(longest * (1 + 1e-9) + 1e-6 < least))
                if not len(open_):
                    break  # all that follow are shorter still
                # partial sum plus Cauchy-Schwarz on the rest is above every score
                bound = turned[open_, : self.head] @ self.turned[block, : self.head].T
                bound += np.outer(rest[open_], self.rest[block]) + (1e-9 * longest[open_] + 1e-6)[:, None]
            q, c = np.nonzero(~(bound < least[open_][:, None]))
            q, c = open_[q], c + start
            other = rows[q] != self.rows[c]
            q, c = q[other], c[other]
            for cut in range(0, len(q), 1 << 16):
                part = slice(cut, cut + (1 << 16))
                score = np.einsum("ij,ij->i", longs[q[part]], self.longs[c[part]])
                with np.errstate(over="ignore", invalid="ignore"):
                    large = np.flatnonzero(~(norm[q[part]] * self.norm[c[part]] * (1 + 1e-9) < WHOLE))
                if len(large):
                    score = score.astype(object)
                    score[large] = _long_scores(ints[q[part][large]], self.ints[c[part][large]])
                best = _best(*(np.concatenate(x) for x in zip(best, (q[part], self.ids[c[part]], score), strict=True)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(least)) >= k)
            if len(full):
                last = np.searchsorted(best[0], full, "right") - 1
                least[full] = np.maximum(least[full], _floats(best[2][last]))
        return best


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    by = score if score.dtype != object else np.unique(score, return_inverse=True)[1]
    order = np.lexsort((ids, -by, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    keep = place < k
    return query[keep], ids[keep], score[keep]


def _floats(score: np.ndarray) -> np.ndarray:
    """Scores as doubles; below every score that a double cannot tell from them, with the bounds' margin."""
    if score.dtype != object:
        return score.astype(float)
    return np.array([float(x) if abs(x) < 1 << 1023 else -np.inf for x in score])


def _ints(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy().reshape(-1, dim)


def _thresholds(queries: DataFrame, index: DataFrame, turns: dict[int, np.ndarray], k: int) -> DataFrame:
    """``queries`` with ``least``: their k-th best score among the longest vectors."""
    rows = index.orderBy(F.desc("norm"), "row_no").limit(SEED_ROWS).select("row_no", "id", "dim", "ints").collect()
    seeds: dict[int, list] = {}
    for row in rows:
        seeds.setdefault(row.dim, []).append(row)

    def scan(batches):
        groups = {
            d: Group(np.array([r.row_no for r in s]), np.array([r.id for r in s]), np.array([r.ints for r in s]), turns.get(d))
            for d, s in seeds.items()
        }
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            dims = batch.column("dim").to_numpy()
            numbers = batch.column("row_no").to_numpy()
            for d in np.unique(dims):
                if int(d) in groups:
                    at = np.flatnonzero(dims == d)
                    ints = _ints(batch.take(pa.array(at)), int(d))
                    q, _, score = groups[int(d)].search(numbers[at], ints, np.full(len(at), -np.inf), k)
                    full = np.flatnonzero(np.bincount(q, minlength=len(at)) >= k)
                    least[at[full]] = _floats(score[np.searchsorted(q, full, "right") - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], [*batch.schema.names, "least"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(scan, f"{schema}, least double")


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    ``queries`` is a condition on column ``id``; its rows are compared with every other row
    of their own length, in fixed point, so results are exact. Ties go to the smaller
    vec_id. With fewer than k other rows all are returned.

    Candidates are sorted by falling length over the cluster and cut into groups of about
    ``group_rows``. Each query gets a threshold from the longest vectors, is sent only to
    groups whose longest vector can still reach it, and there passes over candidates whose
    partial sum and rest cannot. A task holds one group, and queries in batches.

    Vectors that are null or empty, or hold a null or a component that times 256 is not
    finite, take no part, nor do rows without identifier. Scores beyond 63 bits are ranked
    exactly and given as the largest or smallest of those. Rows that repeat an
    identifier are rows of their own: they are candidates for one another, and each asks.
    An empty table gives no rows; other columns do not matter.
    """
    spark = vectors.sparkSession
    rows = stored(fixed_point(vectors, id_col, vector_col), "vectors")
    groups = max(1, -(-rows.count() // group_rows))
    spread = rows.repartitionByRange(groups, F.col("dim"), F.desc("norm"), F.col("row_no"))
    index = stored(spread.withColumn("part", F.spark_partition_id()), "vector-index")
    turns = rotations(index)
    asked = stored(_thresholds(index.where(queries), index, turns, k), "vector-queries")
    bounds = stored(index.groupBy("dim", "part").agg(F.max("norm").alias("longest")), "vector-bounds")
    reach = F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least")
    sent = asked.drop("part").join(bounds, "dim").where(reach)
    columns = ["dim", "part", "kind", "row_no", "id", "ints", "least"]
    candidates = index.select("*", F.lit(0).alias("kind"), F.lit(0.0).alias("least")).select(columns)
    tiles = candidates.unionByName(sent.select("*", F.lit(1).alias("kind")).select(columns))
    tasks = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tiles.repartition(tasks, "dim", "part").sortWithinPartitions("dim", "part", "kind")

    def search(batches):
        key, held, group = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "part", "kind")], 1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                dim, part, kind = (int(x) for x in marks[a])
                piece = batch.slice(a, b - a)
                if (dim, part) != key:
                    key, held, group = (dim, part), [], None
                numbers, ids = piece.column("row_no").to_numpy(), piece.column("id").to_numpy()
                if kind == 0:
                    held.append((numbers, ids, _ints(piece, dim)))
                    continue
                if group is None:
                    group = Group(*(np.concatenate(x) for x in zip(*held, strict=True)), turns.get(dim))
                q, found, score = group.search(numbers, _ints(piece, dim), piece.column("least").to_numpy(), k)
                beyond = pa.nulls(len(q), pa.binary())
                if score.dtype == object:
                    beyond = pa.array([_sortable(x) for x in score], pa.binary())
                    score = np.array([max(-TOP, min(TOP, x)) for x in score], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[q]), pa.array(ids[q]), pa.array(found), pa.array(score), beyond],
                    ["query_no", "query_id", "vec_id", "score", "beyond"],
                )

    found = dealt.mapInArrow(search, "query_no long, query_id long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
