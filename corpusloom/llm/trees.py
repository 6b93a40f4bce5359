"""Gradient-boosted regression trees over binned features, small and in array operations."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Least-squares boosting of trees of fixed depth; leaves of a tree are numbered by their path."""

    def __init__(self, trees: int = 100, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(column, levels)) if len(y) else np.zeros(0) for column in x.T]
        binned = self._bin(x)
        self.base = float(y.mean()) if len(y) else 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rest = y - self.base
        for _ in range(self.trees if len(y) else 0):
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 255, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    own = np.flatnonzero(node == k)
                    if len(own) >= 2 * self.least:
                        feature[first + k], cut[first + k] = self._split(binned[own], rest[own])
                node = node * 2 + (binned[np.arange(len(y)), feature[first + node]] > cut[first + node])
            total = np.bincount(node, rest, 2**self.depth)
            value = self.rate * total / (np.bincount(node, minlength=2**self.depth) + 1.0)
            rest = rest - value[node]
            self.nodes.append((feature, cut, value))
        return self

    def _split(self, binned: np.ndarray, rest: np.ndarray) -> tuple[int, int]:
        best, at = 1e-9, (0, 255)
        whole = rest.sum() ** 2 / len(rest)
        for f in range(binned.shape[1]):
            n = np.bincount(binned[:, f], minlength=self.bins).cumsum()[:-1]
            s = np.bincount(binned[:, f], rest, self.bins).cumsum()[:-1]
            m = len(rest) - n
            ok = (n >= self.least) & (m >= self.least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (rest.sum() - s) ** 2 / np.maximum(m, 1) - whole, 0)
                if (k := int(gain.argmax())) >= 0 and gain[k] > best:
                    best, at = float(gain[k]), (f, k)
        return at

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(self.cuts, x.T, strict=True)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        columns = [np.searchsorted(c, column, side="left").astype(np.uint8) for c, column in zip(self.cuts, x.T, strict=True)]
        for feature, cut, value in self.nodes:
            tests = [columns[f] > c for f, c in zip(feature, cut, strict=True)]
            out += _leaf(tests, value, 0, 0, self.depth)
        return out


def _leaf(tests: list, value: np.ndarray, node: int, path: int, depth: int) -> np.ndarray:
    if not depth:
        return value[path]
    return np.where(
        tests[node],
        _leaf(tests, value, 2 * node + 2, 2 * path + 1, depth - 1),
        _leaf(tests, value, 2 * node + 1, 2 * path, depth - 1),
    )
