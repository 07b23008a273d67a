"""Quality classifier: learned word, word-pair and character n-gram vectors, averaged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pagetally.llm.classify import held_out, labelled_sample, report
from pagetally.llm.subwords import Corpus, Scorer, Settings, Softmax

FOLDS, FOLD = 5, 0  # the fold that is never learned from
TRAIN_ROWS = 3000  # most labelled rows that are learned from
THRESHOLD = 0.3
SETTINGS = Settings(pairs=True, epochs=3)


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space; case tells quality, so it is kept."""
    return text.split()


def fit(rows: list[tuple[bytes, int]], settings: Settings = SETTINGS) -> Scorer:
    """Learn from (text, label) rows, each whole text as the mean of its word, pair and n-gram vectors.

    Without rows, or with one class only, every text gets that class's share.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Scorer(settings, np.zeros(settings.buckets, np.float32), float(np.log(share / (1 - share))))
    corpus, model = Corpus((words(text) for text, _ in rows), settings), Softmax(settings)
    for _ in range(settings.epochs):
        model.learn(corpus, corpus.begin, corpus.sizes, labels)
    return model.scorer()


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_ROWS
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of ``docs``.

    Learns from at most ``bound`` labelled rows outside the held-out fold and scores all
    whole texts; null and empty ones get the score of no evidence. Rows that repeat an
    identifier are scored each. A null identifier counts as the empty text for the fold.
    Empty tables give no rows; without labels all scores are 0.5.
    """
    keep = ~held_out(id_col, FOLDS, FOLD)
    scorer = fit(labelled_sample(docs, labels, "quality", keep, bound, id_col, text_col))
    return report(docs, lambda text: scorer.whole(words(text)), FOLDS, FOLD, THRESHOLD, id_col, text_col)
