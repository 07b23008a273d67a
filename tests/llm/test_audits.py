"""Sharding, vector codes and filter audits against plain re-computations."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import filter_audit, shards, vector_codes
from tests.conftest import plan_of

LONG = (1 << 63) - 1


def documents(spark, n, seed=0):
    """Hot copies, equal identifiers, nulls, a very long text."""
    draw = random.Random(seed)
    words = ["One", "two", "$3", "FOUR", "five", "six\n", "été", ""]
    rows = []
    for i in range(n):
        text = "hot copy" if i % 3 == 0 else " ".join(draw.choices(words, k=draw.randint(0, 40)))
        rows.append((None if i % 17 == 0 else i // 2, None if i % 29 == 0 else text, draw.choice(["en", "de", None, ""])))
    rows += [(7, "same row", "en")] * (n // 3) + [(n, "long " * 5000, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def middles(docs, n):
    """Shard of each row's middle, rows laid end to end by key."""
    def size(r):
        return len((r.text or "").encode()) + 8

    def key(r):
        name = "" if r.doc_id is None else str(r.doc_id)
        return hashlib.md5((r.text or "").encode()).hexdigest() + hashlib.md5(name.encode()).hexdigest()[:16]

    rows, below, want = sorted(docs.collect(), key=key), 0, []
    total = sum(map(size, rows))
    for r in rows:
        want.append((r.doc_id, r.text, n * (2 * below + size(r)) // (2 * total)))
        below += size(r)
    return want


@pytest.mark.parametrize("n", [1, 5, 24, 400])
def test_shards_are_cut_at_the_middle_of_a_row(spark, n):
    docs = documents(spark, 200)
    rows = shards.shard_documents(docs, n).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in rows) == Counter(middles(docs, n))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_large_shards_use_many_tasks(spark):
    docs = documents(spark, 200)
    key, size = F.coalesce("text", F.lit("")), shards.text_size(F.col("text"))
    whole = shards.histogram_sort(docs, key, size, 3)
    parts = shards.histogram_sort(docs, key, size, 3, part_bytes=1000)
    assert whole.groupBy("shard").count().orderBy("shard").collect() == parts.groupBy("shard").count().orderBy("shard").collect()
    slots = defaultdict(list)
    for r in parts.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert parts.rdd.getNumPartitions() > 3
    ends = whole.where("text is not null").groupBy("shard").agg(F.min("text"), F.max("text")).orderBy("shard").collect()
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(ends))  # shards are ranges of the key


def test_tolerance_takes_fewer_passes(spark):
    docs = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(10).cast("long").alias("size"))
    loose, exact = shards.splitters(docs, 8, 0.05), shards.splitters(docs, 8)
    keys = np.array(sorted(r.key for r in docs.collect()))
    at = [np.searchsorted(keys, b) for b in exact]
    assert at == [2500 * s for s in range(1, 8)]
    assert all(abs(np.searchsorted(keys, b) - 2500 * s) <= 125 for s, b in enumerate(loose, 1))


def test_one_exchange_of_the_rows(spark):
    placed = shards.shard_documents(documents(spark, 30), 4)
    assert plan_of(placed).count("direct_shuffle_partition_id") >= 1
    assert "hashpartitioning(__part" not in plan_of(placed).split("Initial Plan")[-1]
    assert "Python" not in plan_of(placed) and "Arrow" not in plan_of(placed)


def test_shard_edges(spark, odd_docs, no_docs):
    clash = odd_docs.withColumns({c: F.lit("user") for c in ("shard", "slot", "__key", "__size", "__part", "__at", "__offset")})
    rows = shards.shard_documents(clash, 3)
    assert rows.columns == [*clash.columns, "_shard", "_slot"]
    assert rows.count() == 10 and {r["__key"] for r in rows.collect()} == {"user"}
    assert shards.shard_documents(no_docs, 3).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(odd_docs, 0)


def plain_codes(vectors, parts, entries, rounds):
    """Nested loops over Python numbers; vectors in the order of their identifiers."""
    ints = [[int(np.floor(np.float64(x) * 4096)) for x in v] for v in vectors]
    cut = [p.tolist() for p in np.array_split(range(len(ints[0])), parts)]
    books = [[[v[j] for j in part] for v in ints[:entries]] for part in cut]

    def nearest(v, part, book):
        far = [sum((v[j] - e) ** 2 for j, e in zip(part, entry, strict=True)) for entry in book]
        return min(zip(far, range(len(far)), strict=True))

    for _ in range(rounds):
        after = []
        for part, book in zip(cut, books, strict=True):
            sums, counts = [[0] * len(part) for _ in book], [0] * len(book)
            for v in ints:
                _, k = nearest(v, part, book)
                counts[k] += 1
                sums[k] = [s + v[j] for s, j in zip(sums[k], part, strict=True)]
            after.append([[s // n for s in t] if n else e for t, n, e in zip(sums, counts, book, strict=True)])
        books = after
    rows = []
    for v in ints:
        found = [nearest(v, part, book) for part, book in zip(cut, books, strict=True)]
        rows.append(("".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), LONG)))
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    return rows, hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize(("dim", "n", "reach"), [(16, 300, 1.0), (11, 90, 0.02), (3, 40, 5.0), (8, 5, 1.0), (8, 60, 3e4), (8, 60, 1e30)])
def test_vector_codes(spark, dim, n, reach):
    draw = np.random.default_rng(dim * n)
    vectors = (draw.standard_normal((n, dim)) * reach).astype(np.float32)
    vectors[n // 2] = vectors[0]
    vectors[:, 0] = np.round(vectors[:, 0], 1)
    if reach > 1e4:  # a few large ones among small ones
        vectors[10:] /= np.float32(reach)
    frame = spark.createDataFrame([(i, v.tolist(), i % 3 or None) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    found = vector_codes.compress(frame.repartition(4))
    rows, sha = plain_codes(vectors, 8, 16, 6)
    got = {r.vec_id: (r.code, r.error) for r in found.rows.collect()}
    assert [got[i] for i in range(n)] == rows and found.digest() == sha
    sums = vector_codes.with_group_error(found.rows, "label").collect()
    want = defaultdict(int)
    for i, (_, error) in enumerate(rows):
        want[i % 3 or None] += error
    assert len(sums) == n and all(r.group_error == min(want[r.label], LONG) for r in sums)


def test_vector_code_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0], 1), (1, [1.0, nan], 1), (1, None, 1), (2, [None, 1.0], 1), (2, [inf, 0.0], None), (None, [0.0, 1.0], None)]
    rows += [(3, [1.0, 2.0], 1), (4, [1.0], 2), (5, [], 2), (6, [-1e308, 1e308], 2), (7, [-0.1, -1e-320], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("code", "error")})
    found = vector_codes.compress(frame)
    assert found.rows.columns == [*frame.columns, "_code", "_error"]
    got = found.rows.collect()
    assert sorted((r.vec_id for r in got), key=str) == [3, 3, 7, None] and all(r._error == 0 for r in got)
    assert found.codebook.tolist() == [[4096, 8192], [4096, 8192], [-410, -1], [0, 4096]]
    assert vector_codes.compress(frame.limit(0)).rows.count() == 0
    assert vector_codes.compress(frame.where("vec_id = 5")).rows.select("_code", "_error").collect() == [("00" * 8, 0)]


def test_path_counts():
    forward, backward = filter_audit.path_counts(5)
    assert forward[-1] == backward[0] == 120
    assert [sum(f * b for s, (f, b) in enumerate(zip(forward, backward, strict=True)) if s.bit_count() == k) for k in range(6)] == [120] * 6


def plain_audit(docs, labels):
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    labels = labels.collect()
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    told = defaultdict(list)
    for i, t, part in docs:
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        told[part].append(({f for f, failed in fails.items() if failed}, i in good, i in toxic))
    rows, shapley = {}, Counter()
    for part, found in told.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d in found if f in d[0] and not d[0] & before]
                rows[part, "".join(order), step] = [
                    sum(not d[0] & (before | {f}) for d in found),
                    len(removed),
                    sum(f in d[0] and bool(d[0] & before) for d in found),
                    sum(d[0] == {f} for d in found),
                    sum(d[1] for d in removed),
                    sum(d[2] for d in removed),
                ]
                shapley[part, f] += len(removed)
    return {(*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def test_filter_audit(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 5 == 0) for i in range(0, 90, 3)] + [(3, 0, None), (None, 1, True), (3, 1, None)], "doc_id long, quality int, toxic boolean"
    ).withColumn("toxic", F.col("toxic").cast("int"))
    for docs in (documents(spark, 150), odd_docs.withColumns({c: F.lit(1) for c in ("id", "part", "mask", "digest", "n")})):
        rows = filter_audit.audit(docs, labels).collect()
        assert len(rows) == 600 * docs.select(F.coalesce("lang", F.lit(""))).distinct().count()
        assert {tuple(r) for r in rows} == plain_audit(docs, labels)
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(odd_docs, labels.limit(0)).collect()} == {0}


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(i, "x" * i, "en") for i in range(10)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 5)], "doc_id long, stars int")
    n = F.length("text")
    rows = filter_audit.audit(docs, labels, {"s": n < 4, "l": n > 6}, {"starred": F.col("stars") == 5}).collect()
    assert {tuple(r) for r in rows} == {
        ("en", "sl", 1, 6, 4, 0, 4, 1, 8), ("en", "sl", 2, 3, 3, 0, 3, 0, 6), ("en", "ls", 1, 7, 3, 0, 3, 0, 6), ("en", "ls", 2, 3, 4, 0, 4, 1, 8),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {})
