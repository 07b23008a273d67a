"""Katz backoff language model: counted and evaluated in chunks of documents that ask for sums by key.

Words, and the end of a text, are known by 64-bit hashes, pairs of neighbours by a hash of
both. The texts are read once: a chunk of documents becomes a row with its own words and
its tokens as numbers of them. Then each chunk asks three times, with its distinct keys and
what it adds to each, and gets what all chunks add: its words and pairs are counted so, and
the sums of each context, for which one of the chunks that learn from a pair owns it. From the
counts come Good-Turing discounts, and from a context's sums the weight that makes its
probabilities sum to one. A token's probability is its discounted pair count if the pair was
seen, else the context's weight times the word's own probability, which in turn is its
discounted count if the word was seen, else the open share.

    log P(text) = sum over tokens of L2(pair) + S(context) if the pair was seen, else A(context) + L1(word)

with L2 the log of the discounted count, S the log scale of the context, A its log weight and L1
the word's log probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagetally.llm.common import discard, held_out, stored, texts, words

FOLDS, FOLD = 7, 2  # the fold that is never learned from
CUTOFF = 5  # larger counts are not discounted
ROUNDS = 3  # chunks meet their counts in so many rounds, one after the other, to use less disk
CHUNK_TOKENS = 700_000
CHUNK_DOCS = 65_000
PART_TOKENS = 3_000_000  # tokens whose keys one task adds up, about
_START, _END = b" ", b""  # never words; the first two words of each chunk
_ZSTD = pa.Codec("zstd", compression_level=1)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: XXH64


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashed(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 8 bytes, as the SQL function xxhash64 has it for a long."""
    h = seed + _P5 + np.uint64(8)
    h = _turned(h ^ (_turned(value * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """xxhash64(left, right) of SQL."""
    return _hashed(right, _hashed(left, np.full(len(left), 42, np.uint64)))


class _Numbers(dict):
    """Number of each word, by first use."""

    def __missing__(self, word: bytes) -> int:
        return self.setdefault(word, len(self))


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the lowest first, and only as many as the largest needs; compressed."""
    values = values.astype(np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n numbers of ``packed``."""
    out, width = np.zeros((n, 8), np.uint8), data[0]
    if n and width:
        planes = _ZSTD.decompress(memoryview(data)[1:], n * width)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _chunked(docs: DataFrame, id_col: str, held_col: str, text_col: str) -> DataFrame:
    """A row for each chunk of whole documents.

    ``tokens`` are numbers of the chunk's words, whose hashes are ``vocab``: for each document the start, its
    words, and the end. ``learned`` has how often each word is a token to learn from.
    """
    kind = to_arrow_type(docs.schema[id_col].dataType)
    names = ["chunk", "n_tokens", "n_words", "n_docs", "vocab", "learned", "tokens", "sizes", "held", "ids"]

    def scan(batches):
        place, number = TaskContext.get().partitionId() << 20, 0
        found, ids, held, size = _Numbers({_START: 0, _END: 1}), [], [], 0
        tokens: list[np.ndarray] = []

        def row():
            sizes, every = np.array([len(t) for t in tokens]), np.concatenate(tokens)
            learned = np.bincount(every[np.repeat(~np.array(held), sizes)], minlength=len(found))
            learned[0] = 0  # the start is no token
            vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            numbers = [pa.array([x]) for x in (place + number, len(every), len(found), len(tokens))]
            data = [pa.array([packed(x)], pa.binary()) for x in (vocab, learned, every, sizes, np.array(held))]
            return pa.RecordBatch.from_arrays([*numbers, *data, pa.array([ids], pa.list_(kind))], names)

        for batch in batches:
            own, away = batch.column(id_col).to_pylist(), batch.column(held_col).to_pylist()
            for i, text in enumerate(texts(batch, text_col)):
                word = [_START, *words(text), _END]
                tokens.append(np.fromiter(map(found.__getitem__, word), np.uint32, len(word)))
                ids.append(own[i])
                held.append(away[i])
                size += len(word)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield row()
                    number += 1
                    found, ids, held, size = _Numbers({_START: 0, _END: 1}), [], [], 0
                    tokens = []
        if tokens:
            yield row()

    data = "vocab binary, learned binary, tokens binary, sizes binary, held binary"
    fields = f"chunk long, n_tokens long, n_words long, n_docs long, {data}, ids array<{docs.schema[id_col].dataType.simpleString()}>"
    return docs.select(id_col, held_col, text_col).mapInArrow(scan, fields)


def _pairs(vocab: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of each pair's left word, order by key, what is first of its key in that order, distinct keys)."""
    at = np.flatnonzero(tokens[1:] != 0)  # nothing leads to a start
    key = pair_key(vocab[tokens[at]], vocab[tokens[at + 1]])
    order = np.argsort(key)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    return at, order, first, key[first]


_ASKS = "part int, chunk long, n long, keys binary, sums array<binary>"


def _asked(chunk: int, keys: np.ndarray, sums: list[np.ndarray], parts: int) -> list[tuple]:
    """Rows (part, chunk, n, keys, sums) of a chunk's ascending keys and what it adds to each."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the key
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    rows = []
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            steps = np.diff(keys[a:b], prepend=np.uint64(0))
            rows.append((p, chunk, int(b - a), packed(steps), [packed(x[a:b]) for x in sums]))
    return rows


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ASK_FIELDS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("sums", pa.list_(pa.binary()))])


def _added(asks: DataFrame, parts: int, counts: int | None = None) -> DataFrame:
    """(part, chunk, n, sums, seen): the asking rows, with what all chunks together add to their keys.

    With ``counts`` the one sum is told twice over, and one more where the key is owned: by the first chunk that adds to it. A row of each part without chunk has in ``seen`` the sum
    over its keys, the number of them, and the numbers of those with 1, 2, ... ``counts``.
    """
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.binary())), ("seen", pa.list_(pa.int64()))])

    def whole(part, held):
        keys = np.concatenate([h[2] for h in held])
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) != 0)[: len(keys)]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        del keys
        answers, seen = [], None
        for i in range(len(held[0][3])):
            own = np.concatenate([h[3][i] for h in held])
            total = np.add.reduceat(own[order], first)
            answer = np.empty(len(order), own.dtype)
            answer[order] = total[group]
            if counts:
                answer <<= np.uint64(1)
                owner = np.minimum.reduceat(np.where(own[order] > 0, order, len(order)), first)
                answer[owner[owner < len(order)]] |= np.uint64(1)
                few = np.bincount(total[total <= counts].astype(np.int64), minlength=counts + 1)[1:]
                seen = [int(total.sum()), int((total > 0).sum()), *few.tolist()]
            answers.append(answer)
        cuts = np.cumsum([0, *(h[1] for h in held)])
        rows = [(part, h[0], h[1], [packed(x[a:b]) for x in answers], None) for h, a, b in zip(held, cuts[:-1], cuts[1:], strict=True)]
        return _rows([*rows, *([(part, None, 0, [], seen)] if counts else [])], schema)

    def scan(batches):
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "chunk", "n", "keys", "sums")]
            for part, chunk, n, keys, sums in zip(*columns, strict=True):
                if part != now and held:
                    yield whole(now, held)
                    held = []
                now = part
                held.append((chunk, n, np.cumsum(unpacked(keys, n)), [unpacked(x, n) for x in sums]))
        if held:
            yield whole(now, held)

    dealt = asks.repartition(parts, "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(scan, "part int, chunk long, n long, sums array<binary>, seen array<long>")


def _seen(added: DataFrame, counts: int) -> list[int]:
    """What the rows without chunk of ``_added`` tell, of all parts."""
    seen = F.col("seen")
    row = added.where(F.col("chunk").isNull()).agg(*(F.sum(seen[i]).alias(str(i)) for i in range(counts + 2))).first()
    return [x or 0 for x in row]


def discounts(counts: dict[int, int], cutoff: int = CUTOFF) -> list[float]:
    """Katz's Good-Turing discounts of the counts 1..cutoff.

    ``counts`` has the number of events of each count up to cutoff + 1. Where Good-Turing
    gives no factor between 0 and 1, as in small or odd data, half a count is taken off.
    """
    n = [0, *(counts.get(r, 0) for r in range(1, cutoff + 2))]
    common = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    found = []
    for r in range(1, cutoff + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        found.append(d if 0 < d < 1 else (r - 0.5) / r)
    return found


def _discounted(c: np.ndarray, factors: list[float]) -> np.ndarray:
    value = c.astype(np.float64)
    for r, d in enumerate(factors, 1):
        value[c == r] = r * d
    return value


def _met(chunks: DataFrame, answers: list[DataFrame], tasks: int, work, schema: str) -> DataFrame:
    """``work(row, answers)`` of each chunk: its row, and the sums that each table of ``answers`` has for it, in order of keys."""
    fields = [f for f in chunks.schema if f.name != "chunk"]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    both = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<binary>").alias("sums"), *(f.name for f in fields))
    for kind, told in enumerate(answers, 1):
        both = both.unionByName(told.where(F.col("chunk").isNotNull()).select("chunk", F.lit(kind).alias("kind"), "part", "n", "sums", *none))

    tables = len(answers)

    def scan(batches):
        row, held = None, [[] for _ in range(tables)]

        def done():
            sums = [[np.concatenate(x) for x in zip(*h, strict=True)] for h in held]
            return work(row, sums)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                if values[1] == 0:
                    if row is not None:
                        yield from done()
                    row, held = dict(zip(batch.schema.names, values, strict=True)), [[] for _ in range(tables)]
                else:
                    held[values[1] - 1].append([unpacked(x, values[3]) for x in values[4]])
        if row is not None:
            yield from done()

    dealt = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return dealt.mapInArrow(scan, schema)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: int = CUTOFF, rounds: int = ROUNDS
) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows whose identifier is outside the held-out fold, and scores all.
    Tokens are words between ASCII white space, A-Z in lower case, and one end. ``score``
    is the model's log10 probability of the text; ``base_score`` that of single words with
    one added to each count.

    Null texts are empty: one token, the end. A null identifier is the empty text for the
    fold. Rows that repeat an identifier are scored each. Without training rows every
    token has probability 1, for both scores. An empty table gives no rows.
    """
    held = F.coalesce(held_out(id_col, FOLDS, FOLD), F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType
    chunks = stored(_chunked(docs, "id", "held", "text"), "chunks")
    size = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))
    counts = cutoff + 1

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocab = unpacked(row["vocab"], row["n_words"])
                order = np.argsort(vocab)
                asks = _asked(row["chunk"], vocab[order], [unpacked(row["learned"], len(order))[order]], parts)
                yield _rows(asks, _ASK_FIELDS)

    asks = chunks.select("chunk", "n_words", "vocab", "learned").mapInArrow(ask_words, _ASKS)
    word_counts = stored(_added(asks, parts, counts), "word-counts")
    n, v, *few = _seen(word_counts, counts)

    def ask_pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = unpacked(row["tokens"], row["n_tokens"]).astype(np.int64)
                at, order, first, keys = _pairs(unpacked(row["vocab"], row["n_words"]), tokens)
                own = np.repeat(unpacked(row["held"], row["n_docs"]) == 0, unpacked(row["sizes"], row["n_docs"]).astype(np.int64))
                learned = np.add.reduceat(own[at][order].astype(np.uint64), np.flatnonzero(first))
                yield _rows(_asked(row["chunk"], keys, [learned], parts), _ASK_FIELDS)

    of_pairs = chunks.select("chunk", "n_tokens", "n_words", "n_docs", "vocab", "tokens", "sizes", "held")
    pair_counts = stored(_added(of_pairs.mapInArrow(ask_pairs, _ASKS), parts, counts), "pair-counts")
    factors, pair_factors = (discounts(dict(enumerate(x, 1)), cutoff) for x in (few, _seen(pair_counts, counts)[2:]))
    freed = sum(few[r - 1] * r * (1 - d) for r, d in enumerate(factors, 1))
    whole, freed = (n, freed) if freed > 0 else (n + 1, 1.0)
    open_share = freed / whole if n else 1.0

    state = pa.schema([
        *_ASK_FIELDS, ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_docs", pa.int64()), ("order", pa.binary()), ("contexts", pa.binary()),
        ("sizes", pa.binary()), ("held", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), ("ids", pa.list_(to_arrow_type(id_type))),
    ])

    def learn(row, answers):
        """What a chunk's documents have without their contexts, and what it adds to those."""
        (of_words,), (of_pairs,) = answers
        vocab, docs = unpacked(row["vocab"], row["n_words"]), row["n_docs"]
        tokens = unpacked(row["tokens"], row["n_tokens"]).astype(np.int64)
        order = np.argsort(vocab)
        c = np.empty(len(vocab), np.int64)
        c[order] = of_words >> np.uint64(1)
        known = c > 0
        p1 = np.where(known, _discounted(c, factors) / whole, open_share)
        base, p1_log = np.log10((c + 1) / (n + v + 1)), np.log10(p1)
        at, by_key, first, _ = _pairs(vocab, tokens)
        left, right = tokens[at], tokens[at + 1]
        count = (of_pairs >> np.uint64(1)).astype(np.int64)
        weight = _discounted(count, pair_factors)
        own = (of_pairs & np.uint64(1)) == 1
        one = by_key[first][own]
        here, times, after = left[one], count[own], c[right[one]]
        # a context's events, those of its frequent successors, and its pairs by their own and by their successor's small counts
        sums = [np.bincount(here, x, len(vocab)) for x in (times, np.where(after > cutoff, after, 0))]
        sums += [np.bincount(here[x == r], minlength=len(vocab)) for x in (times, after) for r in range(1, cutoff + 1)]
        back = np.empty(len(at), np.int64)
        back[by_key] = np.cumsum(first) - 1
        seen = count[back] > 0
        score = np.where(seen, np.log10(np.where(seen, weight[back], 1)), p1_log[right])
        sizes = unpacked(row["sizes"], docs).astype(np.int64) - 1
        doc = np.repeat(np.arange(docs), sizes)
        values = [np.bincount(doc, x, docs) for x in (known[right], base[right], score)]
        contexts = (left << 1) | seen
        data = [order, contexts, sizes, unpacked(row["held"], docs), values[0], *(x.view(np.uint64) for x in values[1:])]
        numbers = [None, row["chunk"], 0, None, None, len(at), len(vocab), docs]
        yield _rows([(*numbers, *map(packed, data), row["ids"])], state)
        asks = _asked(row["chunk"], vocab[order], [x[order] for x in sums], parts)
        yield _rows([(*a, *[None] * (len(state) - len(a))) for a in asks], state)

    id_sql = f"ids array<{id_type.simpleString()}>"
    fields = "n_tokens long, n_words long, n_docs long, order binary, contexts binary, sizes binary, held binary, known binary, base binary, score binary"
    of_chunks, learned = chunks.drop("learned"), []
    for r in range(rounds):
        now = F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == r
        own = [frame.where(now) for frame in (of_chunks, word_counts, pair_counts)]
        learned.append(stored(_met(own[0], own[1:], parts, learn, f"{_ASKS}, {fields}, {id_sql}"), f"contexts-{r}"))
    for done in (chunks, word_counts, pair_counts):
        discard(done)
    every = learned[0]
    for more in learned[1:]:
        every = every.unionByName(more)
    asks = every.where(F.col("part").isNotNull()).select("part", "chunk", "n", "keys", "sums")
    sums = stored(_added(asks, parts), "context-sums")
    out = pa.schema([
        (id_col, to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def score(row, answers):
        order, docs = unpacked(row["order"], row["n_words"]).astype(np.int64), row["n_docs"]
        told = np.empty((len(answers[0]), len(order)))
        for x, sum_ in zip(told, answers[0], strict=True):
            x[order] = sum_
        total, small, after = told[0], told[2 : cutoff + 2], told[cutoff + 2 :]
        times = np.arange(1, cutoff + 1)
        left = (times * (1 - np.array(pair_factors))) @ small
        seen1 = (told[1] + (times * np.array(factors)) @ after) / whole
        # where no count of a context is discounted, one more unseen event is counted
        none_left = left < 1e-9
        events = np.where(none_left, total + 1, total)
        left = np.where(none_left, 1, left) / events
        weight = np.where(total > 0, np.log10(left / np.maximum(1 - seen1, 1e-300)), 0.0)
        context = unpacked(row["contexts"], row["n_tokens"]).astype(np.int64)
        value = np.where(context & 1, -np.log10(events)[context >> 1], weight[context >> 1])
        sizes = unpacked(row["sizes"], docs).astype(np.int64)
        value = np.bincount(np.repeat(np.arange(docs), sizes), value, docs)
        base, rest = (unpacked(row[x], docs).view(np.float64) for x in ("base", "score"))
        known = unpacked(row["known"], docs).astype(np.int64)
        columns = [row["ids"], unpacked(row["held"], docs) == 1, sizes, known, np.full(docs, n), base, rest + value]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    states = every.where(F.col("part").isNull()).drop("part", "n", "keys", "sums")
    kinds = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _met(states, [sums], parts, score, f"`{id_col}` {id_type.simpleString()}, {kinds}")
