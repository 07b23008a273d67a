"""Operators against plain re-computations on small or given tables."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import compare
from pagetally.llm import bktree, catalog, chains, decontaminate, katz, lines, passages, quality, simhash, subwords, topk, toxicity

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf_dir, name):
    ok, message, _ = compare(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, message


@pytest.mark.parametrize("words", [1, 4])
def test_bk_forest(words):
    random_ = np.random.default_rng(words)
    values = random_.integers(0, 1 << 63, (300, words), dtype=np.uint64)
    values[100:200] = values[:100] ^ (np.uint64(1) << random_.integers(0, 63, (100, words), dtype=np.uint64))
    tree = random_.integers(0, 5, 300)
    tree[100:200] = tree[:100]
    for radius in (0, 3, 20):
        q, n = bktree.Forest(values, tree).search(values, tree, radius)
        near = np.array([[bktree.distances(a[None], b[None])[0] <= radius for b in values] for a in values])
        assert set(zip(q, n, strict=True)) == set(zip(*np.nonzero(near & (tree[:, None] == tree)), strict=True))
    assert len(bktree.Forest(values[:0], tree[:0]).search(values, tree, 3)[0]) == 0


def test_simhash_components(spark):
    """Chains of links, a large shard cut into tiles, equal fingerprints."""
    random_ = random.Random(1)
    fps = [random_.getrandbits(64) for _ in range(300)]
    centre = random_.getrandbits(64)
    for _ in range(400):  # one dense cloud
        fps.append(centre ^ sum(1 << b for b in random_.sample(range(64), random_.randint(0, 4))))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from pagetally.llm.components import component_roots

    got = {r.node: r.root for r in component_roots(simhash.links(frame, shard_rows=16)).collect()}
    values = np.array(fps).view(np.uint64)[:, None]
    q, n = bktree.Forest(values, np.zeros(len(fps), int)).search(values, np.zeros(len(fps), int), 3)
    from pagetally.llm.common import components

    want = components(len(fps), q, n)
    assert {f: got.get(f, f) for f in fps} == {f: fps[w] for f, w in zip(fps, want, strict=True)}


def test_fingerprint_is_spark_xxhash64(spark):
    from pyspark.sql import functions as F

    text = "Some Wörds of a text, more than three"
    word = text.replace("S", "s").replace("W", "w").split()
    grams = [" ".join(word[i : i + 3]) for i in range(len(word) - 2)]
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want


def test_near_copies(spark):
    """Copies with some words changed go, unrelated texts stay."""
    random_ = random.Random(2)
    word = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(random_.choices(word, k=400))) for i in range(40)]
    for i in range(40, 70):
        near = rows[i - 40][1].split()
        for place in random_.sample(range(400), 4):  # about nine tenths of the shingles stay
            near[place] = "changed"
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(40))


def test_near_copies_at_the_bound(spark):
    """Jaccard similarity of the five-word shingles decides, on both sides of 0.8, for many pairs."""
    random_ = random.Random(11)
    word = [f"w{i}" for i in range(100_000)]
    rows, gone = [], set()
    for share in (0.70, 0.75, 0.78, 0.80, 0.82, 0.85):
        for _ in range(40):
            # a text of n shingles and one of its first n * share: the sets' similarity is share
            text = random_.sample(word, 400 + 4)
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[: round(400 * share) + 4]))]
            if share >= 0.8:
                gone.add(len(rows) - 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {i for i, _ in rows} - left == gone


def test_short_near_copies(spark):
    """Eight words and the same with a ninth: similarity 0.8, whose fingerprints differ more than those of long texts."""
    random_ = random.Random(17)
    rows = []
    for i in range(600):
        text = [f"w{random_.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(text[:8])), (2 * i + 1, " ".join(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [2 * i for i in range(600)]


def test_similar_links_in_parts(spark):
    """The same groups however a group of candidates is cut."""
    from pagetally.llm.components import component_roots

    random_ = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[: random_.randint(40, 100)]).encode() for _ in range(40)]
    sets = [simhash.shingles(t, 5) for t in texts]
    pairs = [(a, b) for a in range(40) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.9 * len(np.union1d(sets[a], sets[b]))]
    from pagetally.llm.common import components

    label = components(40, *np.array(pairs).T)
    for parts in (1, 5):
        rows = [(0, parts, i, bytes(32), bytearray(x.tobytes())) for i, x in enumerate(sets)]
        frame = spark.createDataFrame(rows, "root long, parts int, node long, fp binary, hashes binary")
        got = {r.node: r.root for r in component_roots(simhash.similar_links(frame, 60, 0.9)).collect()}
        assert [got.get(i, i) for i in range(40)] == label.tolist()


def test_similar_pairs_come_from_the_tree(monkeypatch):
    """What the BK-tree of a tile finds, and nothing beside it, goes to the sets, which decide."""
    random_ = np.random.default_rng(13)
    bases = random_.integers(0, 1 << 62, (6, 120), dtype=np.uint64)
    sets = [np.unique(random_.choice(bases[i % 6], random_.integers(90, 120), replace=False)) for i in range(60)]
    centers = random_.integers(0, 1 << 62, (6, simhash.WIDE), dtype=np.uint64)
    fp = np.array([centers[i % 6] ^ (np.uint64(1) << np.uint64(i % 3)) for i in range(60)])  # many are equal
    asked = []

    class Spied(simhash.Forest):
        def search(self, queries, tree, radius):
            q, n = super().search(queries, tree, radius)
            asked.append((len(queries), len(q)))
            return q, n

    monkeypatch.setattr(simhash, "Forest", Spied)
    monkeypatch.setattr(simhash, "SEARCH_PAIRS", 100)
    everyone = np.ones(60, bool)
    for member, query in ((everyone, everyone), (np.arange(60) < 30, np.arange(60) >= 30)):
        asked.clear()
        links = simhash._similar(list(range(60)), fp, sets, member, query, 8, 0.8)
        assert sum(n for _, n in asked) >= len(links) > 0
        want = [
            (a, b)
            for a in np.flatnonzero(query)
            for b in np.flatnonzero(member)
            if a != b and simhash.distances(fp[[a]], fp[[b]])[0] <= 8 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        ]
        from pagetally.llm.common import components

        roots = [components(60, *np.array(x).T) for x in (links, want)]
        assert len(links) < len(want) and roots[0].tolist() == roots[1].tolist()
    assert simhash._similar([1, 2], fp[:2], sets[:2], np.zeros(2, bool), np.ones(2, bool), 8, 0.8) == []


def test_katz(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: [" ", *(w.decode() for w in r.text.encode().lower().split()), ""] for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for t in train for w in t[1:])
    c2 = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    n, v = sum(c1.values()), len(c1)
    d1, d2 = katz.discounts(Counter(c1.values())), katz.discounts(Counter(c2.values()))

    def cut(c, d):
        return c * d[c - 1] if c <= len(d) else c

    free = sum(c - cut(c, d1) for c in c1.values()) / n
    context = defaultdict(lambda: [0.0, 0.0, 0.0])

    def p1(w):
        return cut(c1[w], d1) / n if w in c1 else free

    for (a, b), c in c2.items():
        for i, x in enumerate((c, cut(c, d2), p1(b))):
            context[a][i] += x

    def p2(a, b):
        if a not in context:
            return p1(b)
        total, seen, seen1 = context[a]
        scale, left = (1 / (total + 1), 1 / (total + 1)) if total - seen < 1e-9 else (1 / total, (total - seen) / total)
        return cut(c2[a, b], d2) * scale if (a, b) in c2 else left / (1 - seen1) * p1(b)

    for a in list(context)[:20]:  # each context's distribution, one unknown word included
        assert math.isclose(sum(p2(a, b) for b in c1) + p2(a, "\0"), 1, rel_tol=1e-9)
    rows = katz.score_texts(docs).collect()
    assert len(rows) == len(texts)
    held = [0.0, 0.0]
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) - 1, sum(w in c1 for w in t[1:]), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t[1:]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p2(a, b)) for a, b in zip(t, t[1:], strict=False)), rel_tol=1e-9)
        if r.held_out:
            held = [held[0] + r.base_score, held[1] + r.score]
    assert held[1] > held[0]  # held-out texts are likelier than under single words
    again = {(r.doc_id, round(r.score, 6)) for r in katz.score_texts(docs, rounds=1).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in rows}


def test_katz_reads_texts_once(spark):
    """Whatever the model asks of its chunks, no text is read a second time; rounds do not change a score."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    random_ = random.Random(8)
    texts = [(i, " ".join(random_.choices("abcdefghij", k=random_.randint(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in katz.score_texts(docs).collect()}
    assert len(rows) == 200 and read.value == 200
    again = {r.doc_id: r.score for r in katz.score_texts(docs, rounds=3).collect()}
    assert all(math.isclose(rows[i], again[i], rel_tol=1e-9) for i in rows)


def test_word_edits(spark):
    """Random lines over few words: every line against every earlier one."""
    random_ = random.Random(3)
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(" ".join(random_.choices("abc", k=random_.randint(0, 8))) for _ in range(6))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen, want = {}, {}
    for i, text in docs:
        stay = []
        for line in text.split("\n"):
            word = line.split()
            near = any(
                s == line or (max(len(word), len(w)) >= 5 and chains.edits(word, w) <= 1) for s, w in seen.items()
            ) if word else False
            if not near:
                stay.append(line)
            if word:
                seen.setdefault(line, word)
        want[i] = "\n".join(stay)
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    assert got == want


def test_seeds_of_many_texts():
    """The least k-mers of their neighbours, of equal ones the last, for each text by itself; words as elsewhere."""
    random_ = random.Random(12)
    for _ in range(100):
        word = ["a", "B", "\u00e9", "\x1c", *(f"w{i}" for i in range(random_.choice([0, 30, 1000])))]
        gap = lambda: random_.choice([" ", " ", "\n", " \t"])
        many = ["".join(gap() + random_.choice(word) for _ in range(random_.choice([0, 1, 4, 5, 12, 13, 80]))).encode() for _ in range(9)]
        single, size = passages.word_hashes(many, passages._Hashes())
        split = [t.lower().split() for t in many]
        assert size.tolist() == [len(w) for w in split]
        assert len(set(itertools.chain(*split))) == len(set(single.tolist()))
        want = set()
        for i, text in enumerate(many):
            _, code, at = passages.seeds([text], 5, 1)  # every k-mer
            code = code.view(np.uint64).tolist()
            for j in range(max(1, len(code) - 7) if code else 0):
                near = code[j : j + 8]
                place = j + len(near) - 1 - near[::-1].index(min(near))
                want.add((i, int(code[place]), int(at[place])))
        text, code, at = passages.seeds(many)
        assert sorted(want) == sorted(zip(text.tolist(), code.view(np.uint64).tolist(), at.tolist(), strict=True))


def test_seeds_there_once_are_no_rows(spark):
    """Rows are made of the seeds that are there twice or more, in one document or in several, and of no other."""
    random_ = random.Random(13)
    shared, fill = random_.choices(range(1000), k=30), lambda n: random_.choices(range(50_000), k=n)
    texts = [fill(200) + (shared if i % 5 == 0 else []) + fill(random_.choice([0, 100])) for i in range(30)]
    own = fill(40)
    texts += [own + fill(50) + own, [], [7] * 60]
    docs = [(False, i, i, " ".join(map(str, t))) for i, t in enumerate(texts)]
    text, code, at = passages.seeds([d[3].encode() for d in docs])
    count = Counter(code.tolist())
    want = {(i, c, p) for i, c, p in zip(text.tolist(), code.tolist(), at.tolist(), strict=True) if count[c] > 1}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 5):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            keyed = spark.createDataFrame(docs, "missing boolean, id long, hash long, text string").repartition(4)
            rows = [(r.id, r.seed, r.pos) for r in passages.seed_table(keyed, 5, 8).collect()]
            assert len(rows) == len(set(rows)) == len(want) < len(code) // 4 and set(rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edits_are_those_of_the_table():
    random_ = random.Random(14)
    for _ in range(500):
        a, b = (random_.choices("abcd", k=random_.randint(0, 14)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert chains.edits(a, b) == row[-1]


def test_passages(spark):
    """Planted exact and edited passages, several sources, and texts that share nothing."""
    random_ = random.Random(4)
    word = [f"w{i}" for i in range(5000)]
    texts = [random_.choices(word, k=300) for _ in range(40)]
    passage, other = random_.choices(word, k=60), random_.choices(word, k=80)
    for i in (3, 9, 20):
        texts[i][100:100] = passage
    edited = list(other)
    edited[30], edited[55] = "x", "y"
    del edited[45]
    texts[5][50:50] = other
    texts[30][200:200] = edited
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(passages.repeated_passages(docs).collect())
    assert [(r.doc_id, r.start, r.n_words, r.source_id, r.source_start, r.source_words) for r in rows] == [
        (9, 100, 60, 3, 100, 60),
        (20, 100, 60, 3, 100, 60),
        (30, 200, 79, 5, 50, 80),
    ]
    assert [round(r.similarity, 4) for r in rows] == [1.0, 1.0, round(1 - 3 / 80, 4)]
    left = {r.doc_id: r.text.split() for r in passages.drop_passages(docs).collect()}
    assert left[9] == texts[9][:100] + texts[9][160:] and left[3] == texts[3]


def test_passages_apart(spark):
    """Two exact passages of the same two documents, with unlike words between, are both found."""
    random_ = random.Random(8)
    word = [f"w{i}" for i in range(50_000)]
    rows, want = [], set()
    for n, (size, gap) in enumerate([(60, 31), (60, 100), (60, 400), (100, 51), (100, 400)]):
        one, two = random_.choices(word, k=size), random_.choices(word, k=size)
        for i in (2 * n, 2 * n + 1):
            rows.append((i, " ".join([*random_.choices(word, k=70), *one, *random_.choices(word, k=gap), *two, f"end{i}"])))
        want |= {(2 * n + 1, start, size, 2 * n, start, size, 1.0) for start in (70, 70 + size + gap)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in passages.repeated_passages(docs).collect()} == want


def test_passages_seen_in_pieces(spark):
    """Passages whose pieces were first seen in other documents, one of them with a third copy of its middle."""
    random_ = random.Random(10)
    word = [f"w{i}" for i in range(50_000)]
    fill = lambda: random_.choices(word, k=50)
    one, two, three = (random_.choices(word, k=n) for n in (60, 60, 300))
    middle = [fill() + two[5:35] + fill(), fill() + two[:30] + fill(), fill() + two[30:] + fill()]
    stock = [fill() + three[i : i + 30] + fill() for i in range(0, 300, 30)]
    texts = [fill() + one[:30] + fill(), fill() + one[30:] + fill(), *middle, *stock]
    for part in (one, two, three):
        texts += [fill() + part + fill(), fill() + part + fill()]
    n = len(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    assert found == {(n - 5, 50, 60, n - 6, 50, 60, 1.0), (n - 3, 50, 60, n - 4, 50, 60, 1.0), (n - 1, 50, 300, n - 2, 50, 300, 1.0)}


@pytest.mark.parametrize(
    ("size", "edited", "piece", "share"),
    [(60, 0, 30, 0.99), (43, 0, 22, 0.99), (60, 3, 20, 0.95), (60, 6, 30, 0.95), (100, 10, 25, 0.95), (60, 6, 0, 0.95)],
)
def test_edited_passages_seen_in_pieces(spark, size, edited, piece, share):
    """Of 40 passages with changed words, whose pieces other documents had first, this share of words is covered."""
    random_ = random.Random(size + edited + piece)
    word = [f"w{i}" for i in range(50_000)]
    fill = lambda: random_.choices(word, k=50)
    early, whole, late = [], [], []
    for _ in range(40):
        passage = random_.choices(word, k=size)
        copy = list(passage)
        for n in range(edited):  # spread evenly, so that the similarity of every part is that of the whole
            copy[(2 * n + 1) * size // (2 * edited)] = f"new{n}"
        early += [fill() + passage[i : i + piece] + fill() for i in range(0, size, piece)] if piece else []
        whole.append(fill() + passage + fill())
        late.append(fill() + copy + fill())
    texts = early + whole + late
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    covered = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    first = len(texts) - 40
    found = sum(len(covered[i] & set(range(50, 50 + size))) for i in range(first, len(texts)))
    assert found >= share * 40 * size
    assert not any(covered[i] & set(range(45)) for i in range(len(texts)))


@pytest.mark.parametrize(("size", "edited", "piece"), [(60, 3, 20), (60, 6, 30), (100, 10, 25)])
def test_edited_passages_between_pieces(spark, size, edited, piece):
    """As above, where documents after the whole passage have the pieces, too: it is no seed's first or last place.

    As many words are covered as without the documents that have pieces.
    """
    random_ = random.Random(size + edited + piece)
    word = [f"w{i}" for i in range(50_000)]
    fill = lambda: random_.choices(word, k=50)
    early, whole, again, late = [], [], [], []
    for _ in range(40):
        passage = random_.choices(word, k=size)
        copy = list(passage)
        for n in range(edited):
            copy[(2 * n + 1) * size // (2 * edited)] = f"new{n}"
        for side in (early, again):
            side += [fill() + passage[i : i + piece] + fill() for i in range(0, size, piece)]
        whole.append(fill() + passage + fill())
        late.append(fill() + copy + fill())
    found = []
    for texts in (whole + late, early + whole + again + late):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        covered = defaultdict(set)
        for r in passages.repeated_passages(docs).collect():
            covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
        found.append(sum(len(covered[i] & set(range(50, 50 + size))) for i in range(len(texts) - 40, len(texts))))
        assert not any(covered[i] & set(range(45)) for i in range(len(texts)))
    assert found[1] >= found[0] > 30 * size, found


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_near_pairs(spark, rows_a_batch):
    """All pairs of seeds of a document within the distance, wherever a batch ends; equal rows are one."""
    random_ = random.Random(6)
    rows = [(i % 3 == 0, i // 2, i, random_.randrange(30), p) for i in range(20) for p in sorted(random_.sample(range(300), 60))]
    want = {(*a[:3], a[4], a[3], b[4], b[3]) for a in rows for b in rows if a[:3] == b[:3] and 15 <= b[4] - a[4] <= 47}
    frame = spark.createDataFrame(rows + rows[::3], "missing boolean, id long, hash long, seed long, pos int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        found = [tuple(r) for r in passages._near_pairs(frame, 15, 47).collect()]
        once = [tuple(r) for r in passages._near_pairs(frame, 15, 47, once=True).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(want) and {r[:-1] for r in found} == want
    assert len({r[-1] for r in found}) == len({(r[4], r[6]) for r in found})
    firsts = []
    for side in (found, once):
        of = {}
        for r in sorted(side, key=lambda r: (r[3], r[5])):
            of.setdefault((*r[:3], r[-1]), r)
        firsts.append(of)
    assert set(once) <= set(found) and firsts[0] == firsts[1]


def test_links_of_places(spark):
    """First and last places before, over any cut into tasks, for a seed of very many places too."""
    random_ = random.Random(5)
    rows = [(False, i, 0, random_.choice([1, 1, 1, 2, 3, *range(10, 200)]), p) for i in range(60) for p in range(8)]
    frame = spark.createDataFrame([*rows, rows[7]], "missing boolean, id long, hash long, seed long, pos int")
    want, seen = {}, {}
    for _, i, _, seed, p in sorted(rows):
        if seed in seen:
            first, last = seen[seed]
            want[i, p] = (first, None if last == first else last)
        seen[seed] = (seen.get(seed, ((i, p),))[0], (i, p))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found = passages._matches(passages._links(frame)).collect()
            cut = lambda x: x and (x.id, x.pos)
            assert len(found) == len(want)
            assert {(r.id, r.pos): (cut(r.first), cut(r.last)) for r in found} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_segments_are_all_similar_parts():
    """Every part between two matches that is similar enough is covered, and nothing else is told."""
    random_ = random.Random(9)
    for _ in range(300):
        a, b, at, bt = [], [], [], []
        for n in range(random_.randint(2, 9)):
            at.append(len(a))
            bt.append(len(b))
            run = [f"{n}.{i}" for i in range(random_.randint(5, 15))]
            a += run + [f"a{n}.{i}" for i in range(random_.choice([0, 0, 1, 2, 6, 20]))]
            b += run + [f"b{n}.{i}" for i in range(random_.choice([0, 0, 1, 2, 6, 20]))]
        found = chains.segments(a, b, at, bt, 5, 20, 0.8)
        covered = set()
        for a0, a1, b0, b1, same in found:
            assert min(a1 - a0, b1 - b0) >= 20 and same >= 0.8 - 1e-6
            assert chains.edits(a[a0:a1], b[b0:b1]) <= (1 - same) * max(a1 - a0, b1 - b0) + 1e-6
            covered |= set(range(a0, a1))
        for i in range(len(at)):
            for j in range(i, len(at)):
                x, y = a[at[i] : at[j] + 5], b[bt[i] : bt[j] + 5]
                if min(len(x), len(y)) >= 20 and 1 - chains.edits(x, y) / max(len(x), len(y)) >= 0.8:
                    assert set(range(at[i], at[j] + 5)) <= covered


def test_repeated_windows_are_covered(spark, sf_dir):
    docs = {r.doc_id: r.text.encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    covered = defaultdict(set)
    for r in passages.repeated_passages(frame).collect():
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    seen, total, missed = {}, 0, 0
    for i in sorted(docs):
        for p in range(len(docs[i]) - 49):
            window = tuple(docs[i][p : p + 50])
            if len(set(window)) > 10 and seen.setdefault(window, i) != i:
                total += 1
                missed += not set(range(p, p + 50)) <= covered[i]
    assert total and missed <= total // 100


def test_chains():
    a = np.array([0, 5, 10, 12, 15, 20])
    b = np.array([100, 105, 110, 3, 115, 120])
    assert [list(c) for c in chains.chains(a, b)][0] == [0, 1, 2, 4, 5]
    assert chains.edits("abcd", "acd") == 1 and chains.edits("", "ab") == 2 and chains.edits("ab", "ba") == 2


@pytest.mark.parametrize("shard_words", [5, 50, 10_000])
def test_suffix_arrays(spark, shard_words):
    random_ = random.Random(shard_words)
    docs = [(i, " ".join(random_.choices("abcd", k=random_.randint(0, 60)))) for i in range(40)]
    items = [(i, " ".join(random_.choices("abcd", k=random_.choice([0, 3, 7, 12, 15])))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(frame, bench, window=6, shard_words=shard_words).collect()}
    for i, text in docs:
        word, hit, found = text.split(), set(), set()
        for item, other in items:
            part = other.split()
            size = min(6, len(part))
            for s in range(len(part) - size + 1 if size else 0):
                for p in range(len(word) - size + 1):
                    if word[p : p + size] == part[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(word), len(hit), len(found), bool(hit))
    matched = decontaminate.verbatim_matches(frame, bench, window=6, shard_words=shard_words).collect()
    texts = dict(items)
    for r in matched:
        for m in r.matches:
            part = texts[m.item_id].split()[m.item_start : m.item_start + m.n_words]
            assert part == r.text.split()[m.start : m.start + m.n_words] and len(part) >= min(6, len(texts[m.item_id].split()))


def test_top_k(spark):
    from pyspark.sql import functions as F

    random_ = np.random.default_rng(5)
    vectors = random_.normal(0, 1, (500, 12)) * random_.exponential(1, (500, 1))
    vectors[100:200] = vectors[7]  # many ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ints = np.floor(vectors * 256).astype(np.int64)
    for group_rows in (40, 8192):
        got = defaultdict(list)
        for r in topk.top_k(frame, F.col("id") % 10 == 0, group_rows=group_rows).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        for q in range(0, 500, 10):
            score = ints @ ints[q]
            best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_large_components(spark):
    """Scores that 64 bits do not hold are ranked as whole numbers; nothing is left out for its size."""
    from pyspark.sql import functions as F

    random_ = np.random.default_rng(8)
    scale = 10.0 ** random_.choice([0, 3, 7, 12, 30, 170, 300], 300)
    vectors = random_.normal(0, 1, (300, 6)) * scale[:, None]
    vectors[:2] = [[70_000, 0, 0, 0, 0, 0], [70_000, 1, 0, 0, 0, 0]]
    vectors[250:] = vectors[20] * random_.choice([1, -1], (50, 1))  # ties and opposites
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ints = [[math.floor(Fraction(x) * 256) for x in v] for v in vectors.tolist()]
    top = (1 << 63) - 1
    for group_rows in (40, 8192):
        got = defaultdict(list)
        for r in topk.top_k(frame, F.col("id") % 5 == 0, group_rows=group_rows).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        for q in range(0, 300, 5):
            score = [sum(a * b for a, b in zip(ints[q], v, strict=True)) for v in ints]
            best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, max(-top, min(top, -s))) for k, (s, i) in enumerate(best)]


def _labelled(spark, label):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    rows = docs.orderBy("doc_id").select("doc_id", "text", label).collect()
    fold = lambda i, f: zlib.crc32(str(i).encode()) % f
    return [(r.doc_id, r.text.encode(), r[label]) for r in rows], fold


def test_quality_accuracy(spark):
    rows, fold = _labelled(spark, "quality")
    scorer = quality.fit([(t, y) for i, t, y in rows if fold(i, 5) != 0][:2000])
    held = [(scorer.whole(quality.words(t)), y) for i, t, y in rows if fold(i, 5) == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95


def test_toxicity_accuracy(spark):
    rows, fold = _labelled(spark, "toxic")
    scorer = toxicity.fit([(t, y) for i, t, y in rows if fold(i, 4) != 2])
    held = [(toxicity.score(scorer, t), y) for i, t, y in rows if fold(i, 4) == 2]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.92
    assert np.mean([s >= 0.3 for s, y in held if y == 0]) < 0.03
    clean = "the of and in with " * 300
    assert toxicity.score(scorer, (clean + "idiot " + clean).encode()) > 0.3 > toxicity.score(scorer, clean.encode())


def test_scorer_equals_model():
    settings = subwords.Settings(pairs=True, epochs=2)
    texts = [(b"good words here again", 1), (b"bad bad noise", 0), (b"", 1), (b"more good words", 1)] * 5
    scorer = quality.fit(texts, settings)
    corpus = subwords.Corpus([t.split() for t, _ in texts], settings)
    (feature, weight, row), = corpus.bags(corpus.begin, corpus.sizes)
    pull = np.bincount(row, weight * scorer.pulls[feature], len(texts))
    want = 1 / (1 + np.exp(-pull - scorer.bias))
    got = [scorer.whole(t.split()) for t, _ in texts]
    assert np.allclose(got, want)


@pytest.mark.parametrize("pairs", [True, False])
def test_blocks_of_a_text_add_up(pairs):
    """A step over texts cut into blocks is the step over whole ones, pairs at the cuts included."""
    settings = subwords.Settings(pairs=pairs)
    random_ = np.random.default_rng(4)
    texts = [[b"w%d" % x for x in random_.integers(0, 40, n)] for n in (90, 1, 0, 300, 2)]
    corpus, labels = subwords.Corpus(texts, settings), np.array([0, 1, 1, 0, 1])
    whole, cut = subwords.Softmax(settings), subwords.Softmax(settings)
    for _ in range(3):
        whole.step(corpus.bags(corpus.begin, corpus.sizes), labels)
        cut.step(corpus.bags(corpus.begin, corpus.sizes, block=7), labels)
    assert np.allclose(whole.vectors, cut.vectors) and np.allclose(whole.weights, cut.weights)


def test_quality_learns_from_the_end_of_long_texts():
    random_ = np.random.default_rng(6)
    rows = []
    for i in range(60):
        body = random_.choice([b"one", b"two", b"three", b"four"], 20_000).tolist()
        end = [b"lucid" if i % 2 else b"gibber"] * 1_000
        rows.append((b" ".join(body[:-1_000] + end), i % 2))
    scorer = quality.fit(rows)
    assert scorer.whole([b"lucid"]) > 0.5 > scorer.whole([b"gibber"])
    scores = [scorer.whole(t.split()) for t, _ in rows]
    assert min(s for s, (_, y) in zip(scores, rows, strict=True) if y) > max(s for s, (_, y) in zip(scores, rows, strict=True) if not y)


def test_pipeline(spark, sf_dir):
    """Each stage against what its operator says of its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r.doc_id for r in docs.collect()}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir))
    kept = [[r.doc_id for r in f.select("doc_id").collect()] for f in frames]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    assert set(kept[1]) == given - bad and len(kept[1]) == len(given) - len(bad)
    assert sorted(kept[2]) == sorted(kept[1])
    assert len(set(kept[3])) == len(kept[3]) and set(kept[3]) <= set(kept[2])
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.report(frames[3], bench).collect() if r.contaminated}
    assert sorted(kept[4]) == sorted(set(kept[3]) - hit)
    assert set(kept[5]) <= set(kept[4])
    shares = Counter(r.source for r in frames[5].select("source").collect())
    assert frames[4].columns == docs.columns and len(shares) > 1
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(kept[5])
