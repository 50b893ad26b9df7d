"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf is its own child. Prediction is the sum of leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Fit to rows x and labels y (0 or 1). monotone holds -1, 0 or 1 for each feature: the sign that the
    prediction's change with the feature must have, 0 for any."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(k)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        at = np.full(n, roots[-1])
        open_ = {roots[-1]: (-np.inf, np.inf)}
        for level in range(depth + 1):
            following: dict[int, tuple[float, float]] = {}
            for node, (low, high) in open_.items():
                mine = np.flatnonzero(at == node)
                gs, hs = g[mine].sum(), h[mine].sum()
                nodes[node][4] = rate * float(np.clip(-gs / (hs + l2), low, high))
                if level == depth or len(mine) < 2 * least:
                    continue
                best = (1e-6, None)
                for f in range(k):
                    c = code[mine, f]
                    size = len(cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[mine], h[mine], None))
                    if not len(gl):
                        continue
                    wl = np.clip(-gl / (hl + l2), low, high)
                    wr = np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    ok = (nl >= least) & (len(mine) - nl >= least)
                    if monotone[f]:
                        ok &= monotone[f] * (wr - wl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j, wl[j], wr[j]))
                if best[1] is None:
                    continue
                f, j, wl, wr = best[1]
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
                nodes[node][:4] = [f, float(cuts[f][j]), left, right]
                mid = (wl + wr) / 2
                following[left] = (low, mid) if monotone[f] > 0 else (mid, high) if monotone[f] < 0 else (low, high)
                following[right] = (mid, high) if monotone[f] > 0 else (low, mid) if monotone[f] < 0 else (low, high)
                goes_left = code[mine, f] <= j
                at[mine] = np.where(goes_left, left, right)
            open_ = following
        value = np.array([v[4] for v in nodes[roots[-1] :]])
        raw += value[at - roots[-1]]
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots), depth, base)
