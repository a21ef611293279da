"""Subword embeddings averaged into a linear softmax, trained in numpy by stochastic gradient descent.

A word's features are the word itself and its byte n-grams (UTF-8, marked where they begin or end the
word), hashed into 2**BITS buckets, each with a learned vector. A word is the mean of its features, a
bag the weighted mean of its words, and a softmax layer on the bag's vector gives the probability.
Vectors and layer are learned jointly. As the layer is linear, a trained model needs only each
bucket's product with it: scoring adds one number per feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bytetext import LOWER, PUNCTUATION, SPACES, Words, mix

BITS = 18
_IDENTITY = np.arange(256, dtype=np.uint8)
_SALT = np.random.default_rng(11).integers(0, 2**63, 8, dtype=np.uint64)


@dataclass(frozen=True)
class Features:
    """Which features a model reads. plain: lower-case words of letters and digits; else words between white space as they are. pairs: also hashed word pairs, where a repeated word is a pair of its own."""

    sizes: tuple[int, ...]
    plain: bool
    pairs: bool

    def words(self, raw: np.ndarray, at: np.ndarray) -> Words:
        return Words(raw, at, PUNCTUATION if self.plain else SPACES, LOWER if self.plain else _IDENTITY)

    def of_words(self, words: Words, which: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Lists, one for the words and one for each size: buckets, and how many of them each of the words has."""
        mask = np.uint64(2**BITS - 1)
        starts, lengths = words.starts[which], words.ends[which] - words.starts[which]
        buckets, counts = [(mix(words.hashes[which] ^ _SALT[0]) & mask).astype(np.int32)], [np.ones(len(which), np.int64)]
        for n in self.sizes:
            c = np.maximum(lengths - n + 1, 0)
            ends = np.cumsum(c)
            total = int(ends[-1]) if len(ends) else 0
            where = np.repeat(starts - (ends - c), c) + np.arange(total)
            h = words.spans(where, n)
            some = np.flatnonzero(c)
            h[(ends - c)[some]] ^= _SALT[1]
            h[ends[some] - 1] ^= _SALT[2]
            buckets.append((mix(h) & mask).astype(np.int32))
            counts.append(c)
        return buckets, counts

    def of_pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, number of the first word) of neighbouring words of a text; a repetition has one bucket."""
        i = np.arange(max(len(words) - 1, 0))
        text = words.texts()
        i = i[text[i] == text[i + 1]] if len(i) else i
        a, b = words.hashes[i], words.hashes[i + 1]
        h = np.where(a == b, _SALT[3], mix(a * np.uint64(3) + b + _SALT[4]))
        return (mix(h) & np.uint64(2**BITS - 1)).astype(np.int32), i


@dataclass
class Model:
    """values: each bucket's product with the softmax layer; bias: the layer's own."""

    features: Features
    values: np.ndarray
    bias: float

    def word_values(self, words: Words) -> np.ndarray:
        """Each word's share of the logit. Equal words of a chunk are computed once."""
        if not len(words):
            return np.zeros(0)
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        buckets, counts = self.features.of_words(words, first)
        total, n = np.zeros(len(first)), np.zeros(len(first), np.int64)
        for b, c in zip(buckets, counts, strict=True):
            ends = np.concatenate([[0], np.cumsum(c)])
            sums = np.concatenate([[0.0], np.cumsum(self.values[b], dtype=np.float64)])
            total += sums[ends[1:]] - sums[ends[:-1]]
            n += c
        out = (total / n)[inverse]
        if self.features.pairs:
            b, i = self.features.of_pairs(words)
            out[i] += self.values[b]
        return out


def bags(features: Features, words: Words, owner: np.ndarray, n_bags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, offsets) of bags; owner: the bag of each word, ascending. Weights of a bag's words sum to 1."""
    buckets, counts = features.of_words(words, np.arange(len(words)))
    per_word = np.sum(counts, axis=0)
    size = np.bincount(owner, minlength=n_bags)
    weight = 1.0 / (per_word * size[owner])
    b, w, o = [*buckets], [np.repeat(weight, c) for c in counts], [np.repeat(owner, c) for c in counts]
    if features.pairs:
        p, i = features.of_pairs(words)
        b.append(p)
        w.append(1.0 / size[owner[i]])
        o.append(owner[i])
    b, w, o = np.concatenate(b), np.concatenate(w), np.concatenate(o)
    key = o.astype(np.int64) << BITS | b
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    w = np.add.reduceat(w, first) if len(first) else w
    return (key[first] & (2**BITS - 1)).astype(np.int32), w.astype(np.float32), np.searchsorted(key[first] >> BITS, np.arange(n_bags + 1))


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several bags() as one."""
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)
    b, w, at = zip(*parts, strict=True)
    sizes = np.concatenate([np.diff(x) for x in at])
    return np.concatenate(b), np.concatenate(w), np.concatenate([[0], np.cumsum(sizes)])


class Trainer:
    """Vectors of the buckets and a two-class softmax on their bags' means; steps scaled per parameter (Adagrad)."""

    def __init__(self, dim: int, seed: int = 3, rate: float = 0.3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (2**BITS, dim)).astype(np.float32)
        self.layer = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen, self.seen_layer, self.seen_bias = np.full(2**BITS, 1e-6, np.float32), np.full_like(self.layer, 1e-6), np.full(2, 1e-6, np.float32)
        self.rate, self.rng = rate, rng

    def step(self, b: np.ndarray, w: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        """One step on bags that each have a feature."""
        z = np.add.reduceat(self.vectors[b] * w[:, None], at[:-1])
        logits = z @ self.layer + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g_layer, g_bias, g_z = z.T @ p / len(y), p.mean(0), p @ self.layer.T
        order = np.argsort(b, kind="stable")
        first = np.flatnonzero(np.diff(b[order], prepend=-1))
        rows = b[order][first]
        g = np.add.reduceat((np.repeat(g_z, np.diff(at), axis=0) * w[:, None])[order], first)
        self.seen[rows] += (g * g).mean(1)
        self.vectors[rows] -= self.rate * g / np.sqrt(self.seen[rows])[:, None]
        self.seen_layer += g_layer**2
        self.layer -= self.rate * 0.2 * g_layer / np.sqrt(self.seen_layer)
        self.seen_bias += g_bias**2
        self.bias -= self.rate * 0.2 * g_bias / np.sqrt(self.seen_bias)

    def epoch(self, b: np.ndarray, w: np.ndarray, at: np.ndarray, y: np.ndarray, which: np.ndarray, batch: int) -> None:
        which = self.rng.permutation(which[np.diff(at)[which] > 0])
        for part in (which[i : i + batch] for i in range(0, len(which), batch)):
            n = at[part + 1] - at[part]
            ends = np.cumsum(n)
            take = np.repeat(at[part] - (ends - n), n) + np.arange(int(ends[-1]))
            self.step(b[take], w[take], np.concatenate([[0], ends]), y[part])

    def model(self, features: Features) -> Model:
        return Model(features, (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))
