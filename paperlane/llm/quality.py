"""Quality: hashed word, word-pair and character n-gram vectors averaged over the document, and a softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import classify
from .subword import Features, Model, Trainer, bags, joined

FEATURES = Features(sizes=(2, 3), plain=False, pairs=True)
FOLDS, FOLD, THRESHOLD = 5, 0, 0.3
DIM, EPOCHS, BATCH = 8, 5, 32


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.quality, fitted to rows that aren't held out. Without any labelled text it says 0.5."""
    raw, at, y = classify.training_rows(docs, labels, "quality", FOLDS, FOLD)
    trainer = Trainer(DIM)
    if len(y):
        parts = []
        for own, own_at, _ in classify.slices(raw, at):
            words = FEATURES.words(own, own_at)
            parts.append(bags(FEATURES, words, words.texts(), len(own_at) - 1))
        b, w, bag_at = joined(parts)
        for _ in range(EPOCHS):
            trainer.epoch(b, w, bag_at, y, np.arange(len(y)), BATCH)
    return trainer.model(FEATURES)


def logits(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A document's logit: the mean of its words, and the bias."""
    words = model.features.words(raw, at)
    sums = np.concatenate([[0.0], np.cumsum(model.word_values(words))])
    return (sums[words.at[1:]] - sums[words.at[:-1]]) / np.maximum(np.diff(words.at), 1) + model.bias


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text; other columns are ignored).

    A null text or one without words has the score of the bias alone. Repeated rows are scored each; a
    null doc_id stays null and counts as held out. An empty table gives an empty result.
    """
    return classify.score(docs, model or train(docs, labels), logits, FOLDS, FOLD, THRESHOLD)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject (score >= THRESHOLD)."""
    return classify.keep(docs, model, logits, lambda p: p >= THRESHOLD)
