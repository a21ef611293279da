"""Toxicity: subword-bag embeddings averaged over windows of words, and a softmax; a document is its worst window.

Misspelt words share their n-gram vectors with the words that the model has seen. A few words
make a long document toxic, so averages are taken over windows of WINDOW words; the document's
label first teaches all its windows, then only the window that scores highest. A word said again
within two words counts once, so that no repetition fills a window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import classify
from .subword import Features, Model, Trainer, Words, bags, joined

FEATURES = Features(sizes=(4, 5), plain=True, pairs=False)
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
#: Words of a window; windows begin every STRIDE words.
WINDOW, STRIDE = 8, 4
DIM, EPOCHS, WORST_EPOCHS, BATCH = 8, 2, 16, 256
#: Highest windows of each clean document in the later epochs; of a toxic one only the highest is known to be toxic.
HARD = 4
#: Windows of clean documents for each one of toxic documents, in the first epochs.
CLEAN_RATIO = 3


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, offsets by text); a text with few words has one window, a text without words none."""
    n = np.diff(words.at)
    k = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0), 0)
    at = np.concatenate([[0], np.cumsum(k)])
    first = np.repeat(words.at[:-1] - at[:-1] * STRIDE, k) + np.arange(at[-1]) * STRIDE
    return first, np.minimum(first + WINDOW, np.repeat(words.at[1:], k)), at


def _window_logits(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    first, end, at = _windows(words)
    sums = np.concatenate([[0.0], np.cumsum(model.word_values(words))])
    return (sums[end] - sums[first]) / np.maximum(end - first, 1), at


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.toxic, fitted to rows that aren't held out. Without any labelled text it says 0.5."""
    raw, at, y = classify.training_rows(docs, labels, "toxic", FOLDS, FOLD)
    trainer = Trainer(DIM)
    parts = [(own, own_at, y[s]) for own, own_at, s in classify.slices(raw, at)]
    counts = np.zeros(2, np.int64)
    for own, own_at, label in parts:
        counts += np.bincount(label, np.diff(_windows(FEATURES.words(own, own_at).unrepeated())[2]), 2).astype(np.int64)
    share = min(1.0, max(CLEAN_RATIO * counts[1], 1000) / max(counts[0], 1))
    for epoch in range(1 + WORST_EPOCHS if len(y) else 0):
        made, labels_made, model = [], [], trainer.model(FEATURES)
        for own, own_at, label in parts:
            words = FEATURES.words(own, own_at).unrepeated()
            first, end, wat = _windows(words)
            each = np.repeat(label, np.diff(wat))
            if epoch == 0:
                which = np.flatnonzero((each == 1) | (trainer.rng.random(len(each)) < share))
            else:
                order = np.lexsort((-_window_logits(model, words)[0], np.repeat(np.arange(len(label)), np.diff(wat))))
                rank = np.arange(len(order)) - np.repeat(wat[:-1], np.diff(wat))
                which = order[rank < np.where(each == 1, 1, HARD)]
            n = end[which] - first[which]
            ends = np.cumsum(n)
            take = np.repeat(first[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
            made.append(bags(FEATURES, words.subset(take), np.repeat(np.arange(len(which)), n), len(which)))
            labels_made.append(each[which])
        b, w, bag_at = joined(made)
        for _ in range(EPOCHS if epoch == 0 else 1):
            trainer.epoch(b, w, bag_at, np.concatenate(labels_made), np.arange(len(bag_at) - 1), BATCH if epoch == 0 else 64)
    return trainer.model(FEATURES)


def logits(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A document's logit: that of its worst window; the bias alone for a text without words."""
    values, wat = _window_logits(model, model.features.words(raw, at).unrepeated())
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(wat))
    if len(some):
        out[some] = np.maximum.reduceat(values, wat[some])
    return out + model.bias


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text; other columns are ignored).

    A null text or one without words has the score of the bias alone. Repeated rows are scored each; a
    null doc_id stays null and counts as held out. An empty table gives an empty result.
    """
    return classify.score(docs, model or train(docs, labels), logits, FOLDS, FOLD, THRESHOLD)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't call toxic (score < THRESHOLD)."""
    return classify.keep(docs, model, logits, lambda p: p < THRESHOLD)
