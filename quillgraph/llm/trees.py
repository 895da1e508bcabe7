"""Small gradient-boosted trees in numpy, as flat node arrays.

A tree is one row of arrays (feature, threshold, left, right, value); a leaf
points to itself. ``x <= threshold`` goes left. A monotone sign s of a
feature makes the score non-decreasing (+1) or non-increasing (-1) in it:
splits against the sign are refused and children are kept on their side of
the split's middle value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees of one forest, padded to equal size."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row, without a loop over rows."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, lo, hi, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, f[node]] <= t[node], lo[node], hi[node])
            out += v[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds between bins of each feature, midway between neighbouring values."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(c) else np.zeros(0)
        values = np.unique(c)
        nxt = values[np.minimum(np.searchsorted(values, q, side="right"), len(values) - 1)] if len(q) else q
        out.append(np.unique((q + nxt)[nxt > q] / 2))
    return out


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0,
    least: int = 10, monotone: dict[int, int] | None = None, row_share: float = 1.0, seed: int = 7,
) -> Forest:
    """Boost logistic loss. With one class, or without rows, the forest is its base rate."""
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    rate_of = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of / (1 - rate_of)))
    shape = (0 if n == 0 or y.min() == y.max() else trees, nodes)
    f = np.zeros(shape, np.int64)
    t = np.full(shape, np.inf)
    here = np.tile(np.arange(nodes), (shape[0], 1))
    left, right, value = here.copy(), here.copy(), np.zeros(shape)
    forest = Forest(f, t, left, right, value, base, depth)
    if not shape[0]:
        return forest
    edges = _edges(x)
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    flat = binned + np.arange(m) * width
    sign = np.zeros(m)
    for k, s in (monotone or {}).items():
        sign[k] = s
    rng = np.random.default_rng(seed)
    score = np.full(n, base)
    for tree in range(trees):
        p = sigmoid(score)
        g, h = p - y, p * (1 - p)
        used = np.flatnonzero(rng.random(n) < row_share) if row_share < 1 else np.arange(n)
        open_ = [(0, used, -np.inf, np.inf, 0)]
        while open_:
            node, rows, lo, hi, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[tree, node] = rate * np.clip(-gs / (hs + l2), lo, hi)
            if level == depth or len(rows) < 2 * least:
                continue
            cells = flat[rows].ravel()
            stat = lambda w: np.cumsum(np.bincount(cells, w, minlength=m * width).reshape(m, width), axis=1)  # noqa: B023, E731
            gl, hl, cl = stat(np.repeat(g[rows], m)), stat(np.repeat(h[rows], m)), stat(np.ones(len(cells)))
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
            ok = (cl >= least) & (len(rows) - cl >= least) & (sign[:, None] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            k, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[k, b] <= 1e-6 or b >= len(edges[k]):
                continue
            middle = (vl[k, b] + vr[k, b]) / 2
            bounds = [(lo, hi), (lo, hi)]
            if sign[k]:
                bounds = [(lo, middle), (middle, hi)] if sign[k] > 0 else [(middle, hi), (lo, middle)]
            f[tree, node], t[tree, node] = k, edges[k][b]
            left[tree, node], right[tree, node] = 2 * node + 1, 2 * node + 2
            goes = binned[rows, k] <= b
            open_ += [(2 * node + 1, rows[goes], *bounds[0], level + 1), (2 * node + 2, rows[~goes], *bounds[1], level + 1)]
        one = Forest(f[tree : tree + 1], t[tree : tree + 1], left[tree : tree + 1], right[tree : tree + 1], value[tree : tree + 1], 0.0, depth)
        score = score + one.margin(x)
    return forest


def paths(forest: Forest) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conjunction of each node but the roots: ((feature, at most?, threshold), ...), each once, simplified."""
    found: dict[tuple, None] = {}
    for tree in range(len(forest.feature)):
        open_ = [(0, {})]
        while open_:
            node, conds = open_.pop()
            if conds:
                found[tuple(sorted((k, le, thr) for (k, le), thr in conds.items()))] = None
            if forest.left[tree, node] == node:
                continue
            k, thr = int(forest.feature[tree, node]), float(forest.threshold[tree, node])
            a, b = dict(conds), dict(conds)
            a[k, True] = min(thr, a.get((k, True), np.inf))
            b[k, False] = max(thr, b.get((k, False), -np.inf))
            open_ += [(int(forest.left[tree, node]), a), (int(forest.right[tree, node]), b)]
    return list(found)


def holds(rules: list[tuple[tuple[int, bool, float], ...]], x: np.ndarray) -> np.ndarray:
    """rows x rules: does the conjunction hold?"""
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for k, le, thr in rule:
            out[:, j] &= (x[:, k] <= thr) if le else (x[:, k] > thr)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """(intercept, weights) that minimise mean logistic loss + penalty * |weights|, by accelerated proximal steps."""
    n, m = a.shape
    if n == 0 or m == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1.0)
        return float(np.log(rate / (1 - rate))), np.zeros(m)
    # one float32 copy; float64 vectors against it would copy it again in each step
    design = np.empty((n, m + 1), np.float32)
    design[:, :m], design[:, m] = a, 1
    v = np.ones(m + 1, np.float32)
    for _ in range(20):
        v = design.T @ (design @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / float(norm) * 0.9
    beta = np.zeros(m + 1)
    z, momentum = beta.copy(), 1.0
    for _ in range(steps):
        short = (sigmoid((design @ z.astype(np.float32)).astype(float)) - y).astype(np.float32)
        grad = (design.T @ short).astype(float) / n
        new = z - step * grad
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / nxt * (new - beta)
        beta, momentum = new, nxt
    return float(beta[m]), beta[:m]
