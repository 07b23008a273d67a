"""Subword embeddings averaged into a linear softmax, trained in numpy.

A word's features are its own hashed vector and those of its character n-grams, so a word
never seen shares vectors with those that look like it. A text is the mean of its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

_PRIME = np.uint64(1099511628211)
_MIX = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 400_000  # words a task remembers
BLOCK_WORDS = 50_000  # words whose features are held at once in training


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 5
    dim: int = 8
    pairs: bool = False  # hashed pairs of neighbouring words as well
    rate: float = 0.1
    decay: float = 1e-3  # of a vector at each step that uses it
    epochs: int = 6
    batch: int = 32
    seed: int = 11


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = hashes * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def word_features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word index) of every word's vector and character n-grams."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    features, owners = [_bucket(word_hashes(words) + np.uint64(1 << 40), s.buckets)], [np.arange(len(words))]
    for n in range(s.shortest, s.longest + 1):
        count = len(raw) - n + 1
        if count <= 0:
            break
        code = np.full(count, n, np.uint64)
        for k in range(n):
            code = code * _PRIME + raw[k : k + count]
        inside = owner[:count] == owner[n - 1 :]
        features.append(_bucket(code[inside], s.buckets))
        owners.append(owner[:count][inside])
    return np.concatenate(features), np.concatenate(owners)


def pair_features(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Hashed pairs of neighbours; a word that follows itself is one feature, whatever the word."""
    return _pair_features(hashes[:-1], hashes[1:], s)


def _pair_features(left: np.ndarray, right: np.ndarray, s: Settings) -> np.ndarray:
    return _bucket(np.where(left == right, np.uint64(0), left * _PRIME + right) + np.uint64(1 << 41), s.buckets)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Corpus:
    """Training texts as numbers of their distinct words, with each word's features."""

    def __init__(self, texts: Iterable[list[bytes]], s: Settings):
        """Texts come one by one and are not kept: the driver's memory is small."""
        self.settings = s
        place: dict[bytes, int] = {}
        tokens = [np.fromiter((place.setdefault(w, len(place)) for w in t), np.int32, len(t)) for t in texts]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate([*tokens, np.empty(0, np.int32)])
        distinct = list(place)
        del place, tokens
        features, counts = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for start in range(0, len(distinct), 20_000):
            part = distinct[start : start + 20_000]
            feature, owner = word_features(part, s)
            features.append(feature[np.argsort(owner, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(part)).astype(np.int32))
        self.features, self.counts = np.concatenate(features), np.concatenate(counts)
        self.first = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.hashes = word_hashes(distinct) if s.pairs else None

    def word_pulls(self, pulls: np.ndarray) -> np.ndarray:
        """Mean pull of each token's features."""
        return (np.add.reduceat(pulls.astype(np.float32)[self.features], self.first) / self.counts)[self.tokens]

    def bags(self, start: np.ndarray, size: np.ndarray, block: int = BLOCK_WORDS) -> "Bags":
        """Runs of tokens as features, in blocks of at most ``block`` tokens."""
        return Bags(self, start, size, block)

    def features_of(self, at: np.ndarray, end: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, weight, place in ``at``) of tokens at given places.

        Each word counts once, as the mean of its features; each pair counts once, with its
        first word. ``end`` is where a token's run ends, ``total`` what the run counts.
        """
        token = self.tokens[at]
        count = self.counts[token]
        feature = self.features[spread(self.first[token], count)]
        weight = np.repeat(1 / (count * total), count)
        place = np.repeat(np.arange(len(at)), count)
        if self.settings.pairs:
            left = np.flatnonzero(at + 1 < end)
            following = self.tokens[at[left] + 1]
            pairs = _pair_features(self.hashes[token[left]], self.hashes[following], self.settings)
            feature = np.concatenate([feature, pairs])
            weight = np.concatenate([weight, 1 / total[left]])
            place = np.concatenate([place, left])
        return feature, weight, place


class Bags:
    """(feature, weight, row) of whole runs of tokens, block by block; the weights of a run sum to 1.

    What a run of any length needs at once is bounded by the block. A single block is kept
    for the next pass over it; more are made again.
    """

    def __init__(self, corpus: Corpus, start: np.ndarray, size: np.ndarray, block: int):
        self.corpus, self.start, self.size, self.block = corpus, start, size, block
        self.total = size + np.maximum(size - 1, 0) if corpus.settings.pairs else size
        self.words = int(size.sum())
        self._kept: tuple | None = None

    def _block(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens from low to high, counted through all runs."""
        ends = np.cumsum(self.size)
        number = np.arange(low, high)
        row = np.searchsorted(ends, number, "right")
        at = self.start[row] + number - (ends - self.size)[row]
        feature, weight, place = self.corpus.features_of(at, (self.start + self.size)[row], self.total[row])
        return feature, weight, row[place]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.words <= self.block:
            if self._kept is None:
                self._kept = self._block(0, self.words)
            yield self._kept
            return
        for low in range(0, self.words, self.block):
            yield self._block(low, min(low + self.block, self.words))


@dataclass
class Softmax:
    """Feature vectors and the linear layer of two classes, trained together."""

    settings: Settings
    vectors: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)

    def __post_init__(self):
        s = self.settings
        self.random = np.random.default_rng(s.seed)
        self.vectors = self.random.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
        self.weights = self.random.normal(0, 0.3, (s.dim, 2))
        self.bias = np.zeros(2)
        self._past = [np.full(s.buckets, 1e-8), np.full((s.dim, 2), 1e-8), np.full(2, 1e-8)]

    def step(self, bags: Bags, labels: np.ndarray) -> None:
        """One stochastic gradient step with Adagrad's step sizes."""
        s = self.settings
        mean = np.zeros((len(labels), s.dim))
        for feature, weight, row in bags:
            part = self.vectors[feature] * weight[:, None]
            mean += np.stack([np.bincount(row, part[:, d], len(labels)) for d in range(s.dim)], 1)
        error = softmax(mean @ self.weights + self.bias)
        error[np.arange(len(labels)), labels] -= 1
        back = error @ self.weights.T
        keys, pull = np.empty(0, np.int64), np.empty((0, s.dim))
        for feature, weight, row in bags:
            # one row for each feature so far, then those of the block
            every = np.concatenate([keys, feature])
            added, inverse = np.unique(every, return_inverse=True)
            old, new = inverse[: len(keys)], inverse[len(keys) :]
            total = np.stack([np.bincount(new, weight * back[row, d], len(added)) for d in range(s.dim)], 1)
            total[old] += pull
            keys, pull = added, total
        w_pull, b_pull = mean.T @ error / len(labels), error.mean(axis=0)
        self._past[0][keys] += (pull**2).mean(axis=1)
        self.vectors[keys] *= 1 - s.decay
        self.vectors[keys] -= s.rate * pull / np.sqrt(self._past[0][keys])[:, None]
        self._past[1] += w_pull**2
        self.weights -= s.rate * w_pull / np.sqrt(self._past[1])
        self._past[2] += b_pull**2
        self.bias -= s.rate * b_pull / np.sqrt(self._past[2])

    def learn(self, corpus: Corpus, start: np.ndarray, size: np.ndarray, labels: np.ndarray) -> None:
        """One pass over runs of tokens, in random order. Empty runs teach nothing."""
        order = self.random.permutation(np.flatnonzero(size > 0))
        for begin in range(0, len(order), self.settings.batch):
            part = order[begin : begin + self.settings.batch]
            self.step(corpus.bags(start[part], size[part]), labels[part])

    def pulls(self) -> np.ndarray:
        """Each feature's pull towards class 1: the linear layer folded into its vector."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def scorer(self) -> "Scorer":
        """What scoring needs: each feature's pull towards class 1, as one number."""
        return Scorer(self.settings, self.pulls().astype(np.float32), float(self.bias[1] - self.bias[0]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """The model with mean and linear layer folded together; same results, one number a feature."""

    def __init__(self, settings: Settings, pulls: np.ndarray, bias: float):
        self.settings, self.pulls, self.bias = settings, pulls, bias
        self._forget()

    def _forget(self) -> None:
        self._place: dict[bytes, int] = {}
        self._mean = np.empty(0)

    def word_pulls(self, words: list[bytes]) -> np.ndarray:
        """Mean pull of each word's features."""
        if len(self._place) > CACHED_WORDS:
            self._forget()
        place = self._place
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            feature, owner = word_features(new, self.settings)
            total = np.bincount(owner, self.pulls[feature], len(new))
            mean = total / np.bincount(owner, minlength=len(new))
            start = len(place)
            place.update(zip(new, range(start, start + len(new)), strict=True))
            if len(place) > len(self._mean):
                self._mean = np.concatenate([self._mean, np.zeros(len(place))])
            self._mean[start : start + len(new)] = mean
        return self._mean[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def pair_pulls(self, words: list[bytes]) -> np.ndarray:
        return self.pulls[pair_features(word_hashes(words), self.settings)].astype(float)

    def probability(self, pull: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(pull + self.bias, -500, 500))))

    def whole(self, words: list[bytes]) -> float:
        """Probability of class 1 for the mean of the whole text."""
        if not words:
            return self.probability(0.0)
        pulls = self.word_pulls(words)
        if self.settings.pairs and len(words) > 1:
            pulls = np.concatenate([pulls, self.pair_pulls(words)])
        return self.probability(pulls.mean())

    def peak(self, words: list[bytes], window: int) -> float:
        """Highest probability of class 1 among all runs of ``window`` words."""
        if not words:
            return self.probability(0.0)
        pulls = self.word_pulls(words)
        return self.probability(run_means(pulls, window).max())


def run_means(values: np.ndarray, window: int) -> np.ndarray:
    """Mean of every run of ``window`` values; of all values if they are fewer."""
    if len(values) <= window:
        return np.array([values.mean()])
    total = np.cumsum(np.concatenate([[0.0], values]))
    return (total[window:] - total[:-window]) / window
