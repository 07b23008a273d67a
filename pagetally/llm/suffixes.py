"""Word suffix arrays of document shards, and binary search in them."""

from __future__ import annotations

import numpy as np


class TestSet:
    """The windows of the test items, as word numbers.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none,
    is one window. Equal windows of several items are kept once, with all their items.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        places: dict[tuple, dict[int, int]] = {}
        for item, word in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in word]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                places.setdefault(tuple(ids[start : start + size]), {}).setdefault(item, start)
        self.windows = [np.array(w, np.int64) for w in places]
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.places = [list(found.items()) for found in places.values()]
        # what every match begins with: this many words
        self.gram = int(min(3, self.sizes.min())) if len(self.sizes) else 1
        self.base = len(self.number) + 1
        while self.base**self.gram >= 1 << 62:  # so that every run has a number of its own
            self.gram -= 1
        grams = [self.codes(w) for w in self.windows]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.depth = int(self.sizes.max()) - self.gram + 1 if len(self.sizes) else 0
        # each window as gram numbers from 1, padded with -1
        self.rows = np.full((len(grams), max(self.depth, 1)), -1, np.int64)
        for row, codes in zip(self.rows, grams, strict=True):
            row[: len(codes)] = np.searchsorted(self.grams, codes) + 1
        self.lengths = self.sizes - self.gram + 1

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One number for each run of ``gram`` words; words and runs begin together."""
        count = max(0, len(ids) - self.gram + 1)
        code = np.zeros(count, np.int64)
        for k in range(self.gram):
            code = code * self.base + ids[k : k + count]
        return code

    def of_shard(self, ids: np.ndarray) -> np.ndarray:
        """Gram numbers of a shard's positions; 0 where no test gram begins."""
        out = np.zeros(len(ids), np.int64)
        count = len(ids) - self.gram + 1
        if count <= 0 or not len(self.grams):
            return out
        known = np.ones(count, bool)
        for k in range(self.gram):
            known &= ids[k : k + count] > 0
        at = np.flatnonzero(known)
        code = np.zeros(len(at), np.int64)
        for k in range(self.gram):
            code = code * self.base + ids[at + k]
        place = np.searchsorted(self.grams, code)
        place[place == len(self.grams)] = 0
        hit = self.grams[place] == code
        out[at[hit]] = place[hit] + 1
        return out


class SuffixArray:
    """Suffixes of a shard in order of their first ``depth`` gram numbers.

    Only suffixes that begin with a test gram are in it: no other can start a match.
    """

    def __init__(self, grams: np.ndarray, depth: int):
        self.grams = np.concatenate([grams, np.zeros(depth + 1, np.int64)])
        rank, covered = self.grams, 1
        at = np.flatnonzero(grams)
        while covered < depth:  # prefix doubling
            step = min(covered, depth - covered)
            pair = rank[at] * (int(rank.max()) + 1) + rank[at + step]
            _, order = np.unique(pair, return_inverse=True)
            rank = np.zeros(len(self.grams), np.int64)
            rank[at] = order + 1
            covered += step
        self.order = at[np.argsort(rank[at], kind="stable")]

    def _bound(self, rows: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all rows at once."""
        low = np.zeros(len(rows), np.int64)
        high = np.full(len(rows), len(self.order), np.int64)
        column = np.arange(rows.shape[1])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            have = self.grams[self.order[middle][:, None] + column]
            want = rows[open_]
            differs = (have != want) & (column < lengths[open_][:, None])
            first = np.argmax(differs, axis=1)
            line = np.arange(len(open_))
            less = np.where(differs.any(axis=1), have[line, first] < want[line, first], upper)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)

    def ranges(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of the suffixes that begin with each row."""
        return self._bound(rows, lengths, False), self._bound(rows, lengths, True)
