"""Gradient-boosted trees and isotonic calibration for a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth over binned features: per tree the features and bins of its inner nodes, in
    level order, and its leaf values."""
    edges: list[np.ndarray]
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = bin_features(x, self.edges)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def bin_features(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
                ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss; splits maximise the gain over histograms of ``bins`` bins."""
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles, method="lower")) for j in range(x.shape[1])]
    binned = bin_features(x, edges).astype(np.int64)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    margin, inner = np.full(len(y), base), 2 ** depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, bins, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            at = (node - first) * bins
            for j in range(x.shape[1]):
                gl = np.bincount(at + binned[:, j], g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(at + binned[:, j], h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0.0
                top = gain.argmax(axis=1)
                for n in range(width):
                    if gain[n, top[n]] > best[n]:
                        best[n], feature[first + n], cut[first + n] = gain[n, top[n]], j, top[n]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf_g = np.bincount(node - inner, g, inner + 1)
        leaf_h = np.bincount(node - inner, h, inner + 1)
        leaf = rate * leaf_g / (leaf_h + ridge)
        margin += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(edges, np.array(features), np.array(cuts), np.array(leaves), base)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (margin, probability) of the non-decreasing fit, each block's
    mean pulled towards a half by one observation, so that no score is a bare 0 or 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # [sum y, count, sum margin]
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + c]
    b = np.array(blocks)
    p = np.maximum.accumulate((b[:, 0] + 0.5) / (b[:, 1] + 1.0))
    return b[:, 2] / b[:, 1], p
