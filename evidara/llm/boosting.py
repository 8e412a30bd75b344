"""Histogram gradient-boosted trees in numpy: logistic loss, trees flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """All trees' nodes in flat arrays; a leaf points to itself, so that every row can walk depth steps in all trees at once."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    #: Platt scaling of the raw score.
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + 4096] = self.base + self.value[at].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0, calibration: float = 0.2) -> Boosted:
    """Boosted trees on bounded data in the driver. The last calibration share of the rows (deal them at random) only fits
    the Platt scaling. One class alone, or no rows, give a constant score."""
    y = np.asarray(y, float)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    cut = len(y) - int(len(y) * calibration)
    if len(y) < 2 or y[:cut].min() == y[:cut].max():
        zero = np.zeros(1, np.int64)
        return Boosted(zero, np.zeros(1), zero, zero, np.zeros(1), zero, 0, base)
    fit_x, fit_y = x[:cut], y[:cut]
    edges = [np.unique(np.quantile(fit_x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, fit_x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.int64)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    score = np.full(len(fit_y), base)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - fit_y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        level = [(len(nodes) - 1, np.arange(len(fit_y)))]
        for step in range(depth + 1):
            below = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                nodes[node] = [0, 0.0, node, node, -rate * g / (h + penalty)]
                best = None
                if step < depth and len(rows) >= 2 * least:
                    cells = flat[rows].ravel()
                    size = x.shape[1] * width
                    hist_g = np.bincount(cells, np.repeat(grad[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)[:, :-1]
                    hist_h = np.bincount(cells, np.repeat(hess[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)[:, :-1]
                    hist_n = np.bincount(cells, minlength=size).reshape(-1, width).cumsum(1)[:, :-1]
                    gain = hist_g**2 / (hist_h + penalty) + (g - hist_g) ** 2 / (h - hist_h + penalty) - g**2 / (h + penalty)
                    gain[(hist_n < least) | (len(rows) - hist_n < least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = int(f), int(b)
                if best:
                    f, b = best
                    goes = binned[rows, f] <= b
                    kids = (len(nodes), len(nodes) + 1)
                    nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
                    nodes[node] = [f, float(edges[f][b]), *kids, 0.0]
                    below += [(kids[0], rows[goes]), (kids[1], rows[~goes])]
                else:
                    score[rows] += nodes[node][4]
            level = below
    columns = list(zip(*nodes, strict=True))
    model = Boosted(np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.array(columns[4]), np.array(roots), depth, base)
    if cut < len(y) and y[cut:].min() < y[cut:].max():
        model.slope, model.shift = platt(model.raw(x[cut:]), y[cut:])
    return model


def platt(raw: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic calibration by damped Newton steps on smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * raw).sum(), (p - target).sum()])
        hess = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)
