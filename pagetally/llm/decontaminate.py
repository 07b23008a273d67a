"""Benchmark decontamination with suffix arrays over document shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import free_name, texts
from pagetally.llm.suffixes import SuffixArray, TestSet

WINDOW = 10
SHARD_WORDS = 1_000_000  # words of one suffix array; a longer document is one of its own
ITEM_BYTES = 32 << 20  # text of test items that one pass searches for
_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_GAPS = bytes.maketrans(_OTHER, b" " * len(_OTHER))
_FOUND = "array<struct<item_id: bigint, item_start: int, start: int, n_words: int>>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters."""
    return text.lower().translate(_GAPS).split()


def _search(test: TestSet, tokens: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each document: its match rows (item, item start, start, words) and hit marks."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1  # one unknown word stands between documents
    ids = np.zeros(int((sizes + 1).sum()), np.int64)
    for start, token in zip(begin, tokens, strict=True):
        ids[start : start + len(token)] = token
    hit = np.zeros(len(ids) + 1, np.int64)
    none = [np.empty((0, 4), np.int64)] * len(tokens)
    array = SuffixArray(test.of_shard(ids), test.depth)
    if not len(array.order):
        return none, hit[:-1] > 0
    low, high = array.ranges(test.rows, test.lengths)
    parts = []
    for window in np.flatnonzero(high > low):
        at = array.order[low[window] : high[window]]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + test.sizes[window], -1)
        for item, start in test.places[window]:
            parts.append(np.stack([np.full_like(at, item), at - start, at, np.full_like(at, test.sizes[window])], 1))
    if not parts:
        return none, hit[:-1] > 0
    rows = np.concatenate(parts)
    document = np.searchsorted(begin, rows[:, 2], "right") - 1
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], document))
    rows, document = rows[order], document[order]
    # windows of one item on one diagonal that follow one another are one match
    new = np.ones(len(rows), bool)
    new[1:] = (document[1:] != document[:-1]) | (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    new[1:] |= rows[1:, 2] != rows[:-1, 2] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    start = rows[first, 2] - begin[document[first]]
    found = np.stack([rows[first, 0], rows[first, 2] - rows[first, 1], start], 1)
    found = np.column_stack([found, rows[last, 2] + rows[last, 3] - rows[first, 2]])
    cuts = np.searchsorted(document[first], np.arange(len(tokens) + 1))
    return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], np.cumsum(hit[:-1]) > 0


def _pass(docs: DataFrame, text_col: str, items: list, window: int, names: dict[str, str], shard_words: int):
    """Add or extend the columns of one pass: word count, matches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names.values())
    schema += f", `{names['n']}` bigint, `{names['found']}` {_FOUND}"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in ("item_start", "start", "n_words"))]))

    def scan(batches):
        test = TestSet(items, window)
        number = test.number
        for batch in batches:
            tokens, held, found = [], 0, []
            total = np.zeros(batch.num_rows, np.int64)

            def run(tokens=tokens, found=found):
                found.extend(_search(test, tokens)[0])
                tokens.clear()

            for row, text in enumerate(texts(batch, text_col)):
                word = words(text)
                total[row] = len(word)
                if held + len(word) > shard_words and tokens:
                    run()
                    held = 0
                tokens.append(np.fromiter((number.get(w, 0) for w in word), np.int64, len(word)))
                held += len(word)
            run()
            flat = np.concatenate(found) if found else np.empty((0, 4), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            fields = [pa.array(flat[:, 0]), *(pa.array(flat[:, k].astype(np.int32)) for k in (1, 2, 3))]
            rows = pa.StructArray.from_arrays(fields, names=["item_id", "item_start", "start", "n_words"])
            lists = pa.ListArray.from_arrays(offsets, rows).cast(kind)
            if names["found"] in batch.schema.names:  # an earlier pass's matches come first
                before = batch.column(names["found"]).to_pylist()
                lists = pa.array([a + b for a, b in zip(before, lists.to_pylist(), strict=True)], kind)
            kept = [n for n in batch.schema.names if n not in names.values()]
            columns = [*(batch.column(n) for n in kept), pa.array(total), lists]
            yield pa.RecordBatch.from_arrays(columns, [*kept, names["n"], names["found"]])

    return docs.mapInArrow(scan, schema)


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: (item_id, item_start, start, n_words).

    Every task cuts its documents into shards, sorts each shard's word suffixes and finds
    every window of every item by binary search; windows that follow one another in both
    texts are joined to one match, so a match is as long as the texts agree from a
    window's start. Documents are never cut and never shuffled. Where a window repeats
    inside an item, its first place is named.

    The items are sent to the tasks, at most ``item_bytes`` of text at once: a larger
    benchmark is dealt into buckets by its identifier, searched one after the other.
    Null texts have no words and no match. Items without words or identifier never match;
    rows that repeat an identifier are all searched for. An empty benchmark matches
    nothing. A column of ``docs`` that is already named n_words or matches is kept, and the
    new one gets underscores in front.
    """
    names = {"n": free_name(docs, "n_words"), "found": free_name(docs, "matches")}
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    items = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-total // item_bytes) or 1
    for bucket in range(buckets):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(buckets)) == bucket) if buckets > 1 else items
        rows = [(row.item, words(row.text.encode("utf-8"))) for row in part.orderBy("item", "text").collect()]
        docs = _pass(docs, text_col, rows, window, names, shard_words)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of which no word lies in a match; columns, repeats and nulls as they are."""
    matched = verbatim_matches(docs, benchmark, **options)
    found = next(c for c in reversed(matched.columns))
    return matched.where(F.size(F.col(f"`{found}`")) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def words_hit(matches: Column) -> Column:
    """Number of different words that the matches cover."""
    begun = F.array_sort(matches, lambda a, b: a["start"] - b["start"])
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state, match):
        end = match["start"] + match["n_words"]
        more = F.greatest(F.lit(0), end - F.greatest(state["end"], match["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + more).alias("n"))

    return F.aggregate(begun, zero, add, lambda state: state["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: words, hit words, items with their digest, and the verdict."""
    matched = verbatim_matches(docs.select(id_col, F.col(options.get("text_col", "text"))), benchmark, **options)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    out = matched.select(id_col, "n_words", words_hit(F.col("matches")).alias("n_hit"), items.alias("items"))
    return out.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
