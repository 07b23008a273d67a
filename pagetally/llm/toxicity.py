"""Toxicity by subword bags averaged into a linear softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.classify import held_out, labelled_sample, report, with_score
from pagetally.llm.common import free_name, words
from pagetally.llm.subwords import Corpus, Scorer, Settings, Softmax, run_means

FOLDS, FOLD = 4, 2  # the fold that is never learned from
TRAIN_ROWS = 5000  # most labelled rows that are learned from
WINDOW = 3  # words averaged into one bag
OTHERS = 4  # further runs that a round learns from in a text
THRESHOLD = 0.3
SETTINGS = Settings(decay=1e-2)


def fit(rows: list[tuple[bytes, int]], settings: Settings = SETTINGS, window: int = WINDOW) -> Scorer:
    """Learn from (text, label) rows.

    A text is toxic if any run of ``window`` words in it is, however long the rest is. So
    the first round learns from some runs of each text; later ones from the run that the
    model so far holds most toxic, and from some others of texts labelled clean. Without rows, or with one class only, every text gets
    that class's share.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Scorer(settings, np.zeros(settings.buckets, np.float32), float(np.log(share / (1 - share))))
    corpus, model = Corpus((words(text) for text, _ in rows), settings), Softmax(settings)
    size = np.minimum(corpus.sizes, window)
    picks = np.random.default_rng(settings.seed)
    rounds = np.repeat(np.arange(len(rows)), OTHERS)
    for epoch in range(settings.epochs):
        start = corpus.begin[rounds] + picks.integers(0, corpus.sizes[rounds] - size[rounds] + 1)
        if epoch == 0:
            model.learn(corpus, start, size[rounds], labels[rounds])
            continue
        pulls = corpus.word_pulls(model.pulls())
        peaks = corpus.begin + np.array([
            run_means(pulls[b : b + n], window).argmax() if n else 0
            for b, n in zip(corpus.begin, corpus.sizes, strict=True)
        ])
        clean = labels[rounds] == 0
        model.learn(
            corpus,
            np.concatenate([peaks, start[clean]]),
            np.concatenate([size, size[rounds][clean]]),
            np.concatenate([labels, labels[rounds][clean]]),
        )
    return model.scorer()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_ROWS
) -> Scorer:
    """Learn from at most ``bound`` labelled rows outside the held-out fold."""
    keep = ~held_out(id_col, FOLDS, FOLD)
    return fit(labelled_sample(docs, labels, "toxic", keep, bound, id_col, text_col))


def score(scorer: Scorer, text: bytes, window: int = WINDOW) -> float:
    return scorer.peak(words(text), window)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of ``docs``.

    Whole texts are scored; null and empty ones get the score of no evidence. Rows that
    repeat an identifier are scored each. A null identifier counts as the empty text for
    the fold. Empty tables give no rows; without labels all scores are 0.5.
    """
    scorer = train(docs, labels, id_col, text_col)
    return report(docs, lambda text: score(scorer, text), FOLDS, FOLD, THRESHOLD, id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their columns."""
    scorer = train(docs, labels, id_col, text_col)
    name = free_name(docs, "score")
    scored = with_score(docs, text_col, name, lambda text: score(scorer, text))
    return scored.where(F.col(f"`{name}`") < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
