"""Sharding by histogram sort: exact byte counts below candidate boundaries, one exchange."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import free_name, id_text, stored

STEP = 4  # characters of the key that one refinement looks at: 65,536 candidates of a hexadecimal key
PART_BYTES = 64 * 1024 * 1024  # of a shard that one task sorts


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and eight more; a null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _histogram(keys: DataFrame, prefixes: list[str]) -> DataFrame:
    """Exact bytes below each candidate boundary inside the open prefixes.

    Candidates are the open prefixes with ``STEP`` more characters. ``below`` counts from
    the start of the prefix.
    """
    named: dict[int, list[str]] = {}
    for prefix in prefixes:
        named.setdefault(len(prefix), []).append(prefix)
    head = F.coalesce(*[F.when(F.substring("key", 1, n).isin(ps), F.substring("key", 1, n)) for n, ps in named.items()])
    rows = keys.withColumn("prefix", head).where(F.col("prefix").isNotNull())
    bucket = F.expr(f"substring(key, 1, length(prefix) + {STEP})")
    counted = rows.groupBy("prefix", bucket.alias("bucket")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")
    )
    upto = Window.partitionBy("prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("below", F.sum("bytes").over(upto) - F.col("bytes"))


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.0) -> list[str]:
    """The least key of each shard but the first, so that shards have equal bytes.

    ``keys`` has ``key`` (text, no two alike) and ``size``. Splitter s belongs where s / shards
    of all bytes lie below. Each pass counts the exact bytes below candidate boundaries
    and keeps, for every open splitter, the candidate interval that holds its target; the
    next pass refines that one, from the first character in which its keys differ. A
    splitter is done when a boundary of its interval is off by at most ``tolerance`` (a
    share of a shard), or when the interval is one row: then the nearer side of that row
    is taken, the lower one if both are equally near. Only the intervals of open
    splitters, one row each, come to the driver.
    """
    spark = keys.sparkSession
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # all byte counts are multiplied by ``shards``, so targets are whole numbers
    open_ = {s: ("", 0) for s in range(1, shards)} if total else {}
    done: dict[int, str] = {}
    while open_:
        rows = [(s, prefix, total * s - shards * below) for s, (prefix, below) in open_.items()]
        targets = spark.createDataFrame(rows, "s int, prefix string, target long")
        found = _histogram(keys, sorted({prefix for prefix, _ in open_.values()})).join(F.broadcast(targets), "prefix")
        low, high = F.col("below") * shards, (F.col("below") + F.col("bytes")) * shards
        for row in found.where((low <= F.col("target")) & (F.col("target") < high)).collect():
            start = open_[row.s][1] + row.below
            at = total * row.s
            low_off, high_off = at - shards * start, shards * (start + row.bytes) - at
            if row.n == 1 or min(low_off, high_off) <= slack * shards:
                # no key lies between the last one of an interval and that key with one more character
                done[row.s] = row["first"] if low_off <= high_off else row["last"] + "0"
                del open_[row.s]
            else:
                open_[row.s] = (os.path.commonprefix([row["first"], row["last"]]), start)
    return [done[s] for s in sorted(done)]


def histogram_sort(
    rows: DataFrame,
    key: Column,
    size: Column,
    shards: int,
    tolerance: float = 0.0,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shards are ranges of ``key``, a text, with bytes (``size``) as equal as whole rows allow,
    or as ``tolerance`` asks. Rows with equal keys may be cut by a boundary: each row has a
    number of its own behind its key, fixed by writing the rows once. A shard larger than
    ``part_bytes`` is dealt by a hash to several tasks; slots follow the key inside
    each of them, one after the other. So no task holds a shard, and one key may hold
    any share of the rows.

    Null keys count as the empty text, null sizes as 0, and rows without any size all go to the
    first shard. More shards than rows leave shards empty. Empty tables give no rows. Names
    already taken get underscores in front.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    names = "shard", "slot", "__key", "__size", "__part", "__at", "__offset"
    shard, slot, k, z, p, at, offset = (free_name(rows, n) for n in names)
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    keyed = rows.withColumns({k: F.concat(F.coalesce(key, F.lit("")), F.lit("!"), number), z: F.coalesce(size, F.lit(0)).cast("long")})
    keyed = stored(keyed, "shard-rows")
    keys = keyed.select(F.col(k).alias("key"), F.col(z).alias("size"))

    bounds = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))

    def part_of(name: str) -> Column:
        of_shard = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(name))) if bounds else F.lit(0)
        return of_shard * parts + F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")

    shard_of = F.expr(f"cast({p} div {parts} as int)")
    counts = keys.groupBy(part_of("key").alias(p)).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard_of).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(p, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))

    # the one exchange of the rows: one task for a part
    dealt = keyed.withColumn(p, part_of(k)).repartitionById(shards * parts, F.col(p))
    numbered = dealt.withColumn(at, F.row_number().over(Window.partitionBy(p).orderBy(k)))
    placed = numbered.join(stored(offsets, "shard-offsets"), p, "left")
    placed = placed.withColumns({shard: shard_of, slot: F.col(offset) + F.col(at) - F.lit(1)})
    return placed.select(*rows.columns, shard, slot)


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """Whole documents with ``shard`` and ``slot``: shards of near equal bytes (UTF-8 and eight a row).

    The key is a hash of the text and then one of the identifier. So sources are spread
    over all shards, while equal texts lie next to each other: they share a shard unless a
    boundary falls among them. Null texts count as empty ones, null identifiers as the empty
    text; rows that repeat an identifier and its text are told apart by a number. Very
    long texts go whole to one shard.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.md5(text), F.substring(F.md5(id_text(id_col)), 1, 16))
    return histogram_sort(docs, key, text_size(F.col("text")), shards, tolerance)
