"""Sparse linear models on hashed word features: feature extraction in numpy on executors, fitting on a bounded sample."""

from __future__ import annotations

import numpy as np

from loreline.llm import _text as X

PREFIX = 5  # bytes; inflected and compounded forms share a feature


class Features:
    """Presence or share of hashed words and word prefixes. ``cell`` and ``value`` hold the features of text i at first[i]:first[i + 1]."""

    def __init__(self, column, dims: int, share: bool):
        data, offsets = X.bytes_of(column)
        words = X.split_words(data, offsets, X.NOT_ALNUM)
        n = len(offsets) - 1
        whole = X.hash_words(data, words, X.LOWER)
        stem = X.hash_words(data, X.Words(words.start, np.minimum(words.end, words.start + PREFIX), words.text, words.first), X.LOWER) ^ X.U(0x5BD1E995)
        cell = (np.concatenate([whole, X.mix(stem)]) % X.U(dims)).astype(np.int64)
        text = np.concatenate([words.text, words.text])
        key = np.sort(text * dims + cell)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(key)))
        self.cell = (key[begin] % dims).astype(np.int32)
        self.text = key[begin] // dims
        self.first = np.searchsorted(self.text, np.arange(n + 1))
        self.times = times
        self.n_words = np.diff(words.first)
        self.value = times / np.maximum(2.0 * self.n_words[self.text], 1) if share else np.ones(len(begin))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Scores of every text; weights (dims,) or (dims, classes)."""
        n = len(self.first) - 1
        if weights.ndim == 1:
            return np.bincount(self.text, self.value * weights[self.cell], n)
        return np.stack([np.bincount(self.text, self.value * w[self.cell], n) for w in weights.T], axis=1)


class Rows:
    """A sample of ``n`` feature rows in compressed form (cell, value, row of each entry), with products in both directions."""

    def __init__(self, cell: np.ndarray, value: np.ndarray, row: np.ndarray, dims: int, n: int):
        self.cell, self.value, self.row, self.dims, self.n = cell, value, row, dims, n

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.cell], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell, self.value * g[self.row], self.dims)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(loss_grad, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam (Kingma and Ba, 2015); deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = loss_grad(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x
