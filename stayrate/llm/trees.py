"""Gradient-boosted trees for two classes, on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node k has the children 2k+1 and 2k+2."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), int)
            while len(x) and at[0] < len(features):
                at = 2 * at + 1 + (x[rows, features[at]] > cuts[at])
            total += leaves[at - len(features)] if len(x) else 0
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: a logistic curve fitted to margins of rows that the trees have not seen."""
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Trees:
    """Newton steps on the logistic loss; each split is the best of ``bins`` quantiles of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, inner = np.full(len(y), start), 2**depth - 1
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        features, cuts, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for node in range(inner):
            here = at == node
            features[node], cuts[node] = _split(binned[here], g[here], h[here], edges)
            at[here] = 2 * node + 1 + (x[here, features[node]] > cuts[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0)
        margin += value[leaf]
        grown.append((features, cuts, value))
    return Trees(start, *(np.array(part) for part in zip(*grown)))


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
    best = (1e-6, 0, np.inf)
    for f, cut in enumerate(edges):
        if not len(cut) or not len(g):
            continue
        left_g = np.cumsum(np.bincount(binned[:, f], g, len(cut) + 1))
        left_h = np.cumsum(np.bincount(binned[:, f], h, len(cut) + 1))
        gain = left_g**2 / (left_h + 1) + (left_g[-1] - left_g) ** 2 / (left_h[-1] - left_h + 1) - left_g[-1] ** 2 / (left_h[-1] + 1)
        k = int(np.argmax(gain[:-1]))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(cut[k]))
    return best[1], best[2]


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
    """``trees`` with slope and shift fitted to rows that were not used to grow them."""
    margin, slope, shift = trees.margin(x), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        g, h = p - y, p * (1 - p) + 1e-6
        slope -= 0.3 * float((g * margin).sum() / ((h * margin * margin).sum() + 1))
        shift -= 0.3 * float(g.sum() / (h.sum() + 1))
    return Trees(trees.start, trees.features, trees.cuts, trees.leaves, slope, shift)
