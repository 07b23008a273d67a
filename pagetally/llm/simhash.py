"""SimHash near-duplicates: fingerprints, linked by BK-tree search."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.bktree import Forest, distances
from pagetally.llm.common import components, free_name, stored, texts, words
from pagetally.llm.components import component_roots

HASH_SEED = 42
SHARD_ROWS = 2048  # fingerprints in one tree
CHUNK_ROWS = 100_000  # rows a task gathers before it builds their trees
SLICE_ROWS = 1024  # queries that search at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    word = words(text)
    if not word:
        return 0
    if len(word) < shingle:
        grams = [b" ".join(word)]
    else:
        grams = map(b" ".join, zip(*(word[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams), np.dtype(">u8"))
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) of every row, repeated and null identifiers included."""

    def scan(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts(batch, text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def block_masks(radius: int, same: int = 2) -> list[int]:
    """Masks over 64 bits: fingerprints within the radius agree under at least one.

    The bits are cut into radius + same blocks. At most ``radius`` of them differ, so
    ``same`` of them are equal, and each choice of ``same`` blocks is one mask.
    """
    blocks = radius + same
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, same)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _linked(
    node: np.ndarray, fp: np.ndarray, tile: np.ndarray, member: np.ndarray, query: np.ndarray, radius: int, size: np.ndarray, similarity: float
):
    """Star links (node, first of its component) found inside each tile, between sets whose sizes allow that similarity."""
    at = np.flatnonzero(member)
    forest = Forest(fp[at], tile[at])
    asks = np.flatnonzero(query)
    everyone = np.arange(len(node))
    label = everyone.copy()
    for start in range(0, len(asks), SLICE_ROWS):
        part = asks[start : start + SLICE_ROWS]
        q, n = forest.search(fp[part], tile[part], radius)
        a, b = part[q], at[n]
        own, known = a != b, np.flatnonzero(label != everyone)
        own &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        label = components(len(node), np.concatenate([known, a[own]]), np.concatenate([label[known], b[own]]))
    moved = np.flatnonzero(label != everyone)
    return node[moved], node[label[moved]]


def shard_links(keyed: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, similarity: float = 0.0) -> DataFrame:
    """(a, b): links that connect the nodes within ``radius`` bits of one another in a shard.

    ``keyed`` has node (long), fp (binary, all of one length), shard_no (int), shard (long);
    a node is in several shards. With ``similarity`` it has size (long), too: no link joins nodes
    whose sets are of too different sizes to be as similar. A shard of more than ``shard_rows`` is cut into parts, and
    each pair of parts is a tile: a tree never holds more than a part, and a task gets whole
    tiles only. A tile returns a star for each component found in it, not all its pairs.
    Trees go to the tasks that search them by the shuffle: together they hold every
    fingerprint, which is more than may be broadcast.
    """
    shards = keyed.groupBy("shard_no", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = keyed.join(shards, ["shard_no", "shard"]).withColumn("parts", F.expr(f"cast(ceil(n / {shard_rows}) as int)"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        *("shard_no", "shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")),
        *("part", "node", "fp", *(["size"] if similarity else [])),
    )
    key = ["shard_no", "shard", "i", "j"]
    sized = ["size"] if similarity else []

    def search(batches):
        held = None

        def run(rows):
            change = np.zeros(len(rows["i"]), bool)
            for name in key:
                change[1:] |= rows[name][1:] != rows[name][:-1]
            member, query = rows["part"] == rows["i"], rows["part"] == rows["j"]
            size = rows["size"] if sized else np.ones(len(change))
            a, b = _linked(rows["node"], rows["fp"], np.cumsum(change), member, query, radius, size, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = {name: batch.column(name).to_numpy() for name in (*key, "part", "node", *sized)}
            bits = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64)
            new["fp"] = bits.reshape(batch.num_rows, -1) if batch.num_rows else bits.reshape(0, 1)
            if not batch.num_rows:
                continue
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
            if len(held["node"]) >= CHUNK_ROWS:
                same = np.ones(len(held["node"]), bool)
                for name in key:
                    same &= held[name] == held[name][-1]
                whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if whole:
                    yield run({n: v[:whole] for n, v in held.items()})
                    held = {n: v[whole:] for n, v in held.items()}
        if held is not None:
            yield run(held)

    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(tasks, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(search, "a long, b long")


def links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct longs in column fp within ``radius`` bits.

    Fingerprints that agree under a mask form a shard; two within the radius share one.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(radius)))
    keyed = fps.select("fp", F.posexplode(masks).alias("shard_no", "mask")).select(
        F.col("fp").alias("node"),
        F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"),
        "shard_no",
        F.col("fp").bitwiseAND(F.col("mask")).alias("shard"),
    )
    return shard_links(keyed, radius, shard_rows)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest identifier reachable over links of at most ``radius``
    bits. Rows with equal fingerprints are one class and meet as counts, never as pairs.
    Null and wordless texts have fingerprint 0. A row without an identifier belongs to its
    class but names none: a component of such rows only has a null ``component_id``.
    Repeated rows are returned as often as they occur. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-classes")
    roots = component_roots(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(members, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- near copies by similarity: wide fingerprints, shards of documents that share shingles

WIDE = 4  # 64-bit words of a wide fingerprint
# Of two sets with similarity 0.8 all of 16 least hashes differ with a chance of 0.2 ** 16, under 1e-11.
SHARDS = 16  # least shingle hashes that name a document's shards
# Equal bits of the two sets' fingerprints are decided by what they share. Sets of four and five
# shingles differ most often, in 0.1875 of the bits; beyond ten deviations of what large sets differ
# by, 96 of 256 bits, lie under 1e-12 of such pairs, and fewer of all others.
SLACK = 10.0  # standard deviations of the fingerprint distance that a search for candidates allows
TILE_SHINGLES = 1_000_000  # of the sets in one part of a group of candidates
SEARCH_PAIRS = 1 << 20  # of queries and fingerprints of a tile that one search may meet
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(1, SHARDS + WIDE + 1)], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(31))) * _ODD[k]
    return (x ^ (x >> np.uint64(29))) * _ODD[0]


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The set of word shingles as rising hashes; a shorter text is one shingle."""
    word = words(text)
    if not word:
        return np.empty(0, np.uint64)
    if len(word) < shingle:
        grams = [b" ".join(word)]
    else:
        grams = map(b" ".join, zip(*(word[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams), np.uint64))


def sketch(text: bytes, shingle: int) -> tuple[bytes, list[int], int]:
    """Wide SimHash of the set of word shingles, for each shard number the least hash, and the set's size."""
    hashes = shingles(text, shingle)
    if not len(hashes):
        return bytes(8 * WIDE), [0] * SHARDS, 0
    fp = []
    for k in range(WIDE):
        bits = np.zeros(64, np.int64)
        mixed = _mixed(hashes, SHARDS + k)
        for start in range(0, len(mixed), 1 << 16):
            part = mixed[start : start + (1 << 16)]
            bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
        fp.append(np.packbits(2 * bits > len(hashes)).tobytes())
    least = np.array([_mixed(hashes, k).min() for k in range(SHARDS)]).view(np.int64)
    return b"".join(fp), [int(x) for x in least], len(hashes)


def radius_for(similarity: float, bits: int = 64 * WIDE, slack: float = 1.0) -> int:
    """Bits by which sets of that Jaccard similarity differ, and ``slack`` standard deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)


def _similar(node: list[int], fp: np.ndarray, sets: list[np.ndarray], member: np.ndarray, query: np.ndarray, radius: int, similarity: float):
    """Links (node, node) that connect all pairs of a tile with that Jaccard similarity, a pair already connected left out.

    The tile's BK-tree finds the pairs within the radius; their sets decide. Queries of the largest
    component known so far search a tree of what is not in it, so copies are not expanded into all pairs.
    """
    at, asks = np.flatnonzero(member), np.flatnonzero(query)
    if not len(at):
        return []
    size = np.array([len(x) for x in sets])
    label = np.arange(len(node))
    out = []

    def tree_of(rows: np.ndarray):
        values, value = np.unique(fp[rows], axis=0, return_inverse=True)  # equal fingerprints are one node of the tree
        value = value.ravel()
        having = np.split(rows[np.argsort(value, kind="stable")], np.cumsum(np.bincount(value))[:-1])
        return Forest(values, np.zeros(len(values), np.int64)), having

    def search(part: np.ndarray, forest: Forest, having: list[np.ndarray]) -> None:
        found_q, found_v = forest.search(fp[part], np.zeros(len(part), np.int64), radius)
        order = np.lexsort((distances(fp[part[found_q]], forest.values[found_v]), found_q))  # the nearest first
        found_v, cuts = found_v[order], np.searchsorted(found_q[order], np.arange(len(part) + 1))
        for i, q in enumerate(part):
            near = [having[v] for v in found_v[cuts[i] : cuts[i + 1]]]
            near = np.concatenate(near) if near else at[:0]
            if member[q]:
                near = near[near < q]
            fit = np.minimum(size[near], size[q]) >= similarity * np.maximum(size[near], size[q]) - 1e-9
            for n in near[fit & (label[near] != label[q])]:
                if label[n] == label[q]:
                    continue
                shared = len(np.intersect1d(sets[n], sets[q], assume_unique=True))
                if shared >= similarity * (size[n] + size[q] - shared) - 1e-9:
                    label[label == label[n]] = label[q]
                    out.append((node[q], node[n]))

    whole, start, step = tree_of(at), 0, 1
    while start < len(asks):
        part = asks[start : start + step]
        largest = np.bincount(label[at]).argmax()
        inside = label[part] == largest
        others = at[label[at] != largest]
        if not inside.all():
            search(part[~inside], *whole)
        if inside.any() and len(others):
            search(part[inside], *tree_of(others))
        start += step
        step = max(1, min(2 * step, SEARCH_PAIRS // len(at)))
    return out


def similar_links(sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): links that connect the nodes whose sets have that Jaccard similarity, within groups.

    ``sets`` has root (the group), parts (of the group), node, fp and hashes (binary, rising).
    Each pair of parts of a group is a tile, as in ``shard_links``: a BK-tree of one part is
    searched by the other; the sets decide.
    """
    cut = sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "fp", "hashes"
    )
    key = ["root", "i", "j"]

    def search(batches):
        def run(rows):
            fp = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
            part = np.array([r[0] for r in rows])
            hashes = [np.frombuffer(r[3], np.uint64) for r in rows]
            found = _similar([r[1] for r in rows], fp, hashes, part == now[1], part == now[2], radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            names = (*key, "part", "node", "fp", "hashes")
            for *tile, part, node, fp, hashes in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if tile != now:
                    if held:
                        yield run(held)
                    now, held = tile, []
                held.append((part, node, fp, hashes))
        if held:
            yield run(held)

    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(tasks, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(search, "a long, b long")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest identifier.

    Near are texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or
    more; groups are what such links connect. Fingerprints only find candidates, within
    ``SLACK`` standard deviations of what that similarity gives; the sets of shingles decide. Documents that
    share the least of their shingle hashes, under one of ``SHARDS`` hash functions, form a
    shard and its BK-trees. Of pairs with similarity 0.8, of whatever sizes, either step leaves out
    less than one in 100,000,000,000. Texts equal but for case (A-Z) and white space are one node.

    Among equal identifiers the text with the smaller md5 stays; of equal rows one.
    Rows without identifier stay only if their group has no other. Texts without words are
    near copies of one another. Columns are as in ``docs``; an empty table gives no rows.
    """
    row_key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col)))
    row = free_name(docs, "_row_key")
    keyed = docs.withColumn(row, row_key)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            digests, fps, shards, sizes = [], [], [], []
            for text in texts(batch, text_col):
                fp, shard, size = sketch(text, shingle)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words(text))))
                fps.append(fp)
                shards.append(shard)
                sizes.append(size)
            columns = [batch.column(id_col), batch.column(row), pa.array(digests, pa.binary())]
            columns += [pa.array(fps, pa.binary()), pa.array(shards, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row_key", "digest", "fp", "shards", "size"])

    schema = f"id {id_type}, row_key string, digest binary, fp binary, shards array<bigint>, size long"
    rows = stored(keyed.select(id_col, text_col, row).mapInArrow(scan, schema), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row_key")).alias("first")
    nodes = rows.groupBy("digest").agg(first, F.min("fp").alias("fp"), F.min("shards").alias("shards"), F.min("size").alias("size"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    keyed_nodes = nodes.select("node", "fp", "size", F.posexplode("shards").alias("shard_no", "shard"))
    radius = radius_for(similarity, slack=SLACK)
    near = nodes.drop("shards").join(component_roots(shard_links(keyed_nodes, radius, similarity=similarity)), "node")
    groups = near.groupBy("root").agg(F.expr(f"cast(ceil(sum(size) / {TILE_SHINGLES}) as int)").alias("parts"))
    near = near.join(groups, "root").select(F.col("first.row_key").alias("row_key"), "root", "parts", "node", "fp")

    def collect(batches):
        for batch in batches:
            sets = pa.array([shingles(t, shingle).tobytes() for t in texts(batch, "_text")], pa.binary())
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), sets], [*names, "hashes"])

    whole = keyed.select(F.col(row).alias("row_key"), F.col(text_col).alias("_text")).join(near, "row_key").select("root", "parts", "node", "fp", "_text")
    sets = whole.mapInArrow(collect, "root long, parts int, node long, fp binary, hashes binary").dropDuplicates(["node"])
    links_ = similar_links(stored(sets, "shingle-sets"), radius, similarity)
    roots = component_roots(links_)
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    winners = rooted.agg(F.min("first").alias("first")).select(F.col("first.row_key").alias(row))
    kept = keyed.join(winners, row, "left_semi").dropDuplicates([row])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
