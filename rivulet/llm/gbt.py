"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints,
and flat node arrays for vectorised scoring; isotonic calibration by pooling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Least weight of a class relative to an even split, so that rare classes are learned.
EPS = 1e-9


@dataclass
class Trees:
    """Flat arrays over all nodes: a leaf has feature -1; value is a leaf's step."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds; all rows walk one tree at a time, a level per step."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 3.0, l2: float = 1.0, monotone: dict[int, int] | None = None) -> Trees:
    """Trees for P(y = 1).  monotone: by feature, 1 if the score may only rise with it, -1 if
    it may only fall; a split that breaks it isn't taken, and children keep to the bounds that
    their parent's middle sets."""
    monotone = monotone or {}
    n, m = x.shape
    p0 = (y.sum() + 1) / (n + 2)
    base = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1) if n else np.zeros((0, m), dtype=int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add() -> int:
        for arr, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            arr.append(v)
        return len(feature) - 1

    raw = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), EPS)
        roots.append(add())
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2:
                for f in range(m):
                    if not len(edges[f]):
                        continue
                    c = code[rows, f]
                    gl = np.cumsum(np.bincount(c, g[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(edges[f]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(edges[f]) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    if (way := monotone.get(f, 0)) != 0:
                        ok &= way * (vr - vl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (f, k, vl[k], vr[k]))
            if best[1] is None:
                value[node] = float(np.clip(gs / (hs + l2), low, high)) * rate
                raw[rows] += value[node]
                continue
            f, k, vl, vr = best[1]
            feature[node], threshold[node] = f, float(edges[f][k])
            go = code[rows, f] <= k
            left[node], right[node] = add(), add()
            mid = (vl + vr) / 2
            way = monotone.get(f, 0)
            todo.append((left[node], rows[go], level + 1, mid if way < 0 else low, mid if way > 0 else high))
            todo.append((right[node], rows[~go], level + 1, mid if way > 0 else low, mid if way < 0 else high))
    return Trees(np.array(roots, dtype=np.int64), np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value), base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on the score (pool adjacent
    violators); np.interp over them gives a calibrated probability."""
    order = np.argsort(score, kind="stable")
    xs, ys = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, weight, lowest x, highest x
    for a, b in zip(xs, ys, strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t[0], blocks[-1][1] + t[1], blocks[-1][2], t[3]]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    kx = [v for b in blocks for v in (b[2], b[3])]
    ky = [v for b in blocks for v in (b[0] / b[1],) * 2]
    return np.array(kx), np.array(ky)
