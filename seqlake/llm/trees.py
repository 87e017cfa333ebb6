"""Decision trees fitted in numpy on small feature tables and written out as SQL, for scoring inside Spark's own expressions."""

from __future__ import annotations

import numpy as np

Tree = tuple  # (feature, threshold, left, right) or a float


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rng: np.random.Generator, tries: int, least: int = 5, ridge: float = 1.0) -> Tree | float:
    """A tree that maximises the sum of G^2 / (H + ridge) of its leaves; a leaf's value is G / (H + ridge). tries: features looked at in each node."""
    g, h = grad.sum(), hess.sum()
    best = (1e-9, None, None)
    if depth and len(x) >= 2 * least:
        for f in rng.permutation(x.shape[1])[:tries].tolist():
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            gl, hl = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
            ok = v[1:] > v[:-1]
            ok[: least - 1] = False
            ok[len(v) - least :] = False
            if not ok.any():
                continue
            gain = np.where(ok, gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return float(g / (h + ridge))
    left = x[:, best[1]] <= best[2]
    return (best[1], round(float(best[2]), 6), *(grow(x[s], grad[s], hess[s], depth - 1, rng, tries, least, ridge) for s in (left, ~left)))


def predict(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = predict(tree[2], x[left]), predict(tree[3], x[~left])
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 7, seed: int = 5) -> list:
    """A random forest for labels 0 and 1: bootstrap rows, a random root of the features in each node; its mean is a probability."""
    rng = np.random.Generator(np.random.PCG64(seed))
    tries = max(1, round(x.shape[1] ** 0.5))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        out.append(grow(x[rows], y[rows].astype(float), np.ones(len(x)), depth, rng, tries, 3, 1e-9))
    return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, seed: int = 5) -> list:
    """Gradient boosting of the log odds; the trees' values add up to a margin."""
    rng = np.random.Generator(np.random.PCG64(seed))
    margin, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        t = _scaled(grow(x, y - p, p * (1 - p), depth, rng, x.shape[1]), rate)
        margin += predict(t, x)
        out.append(t)
    return out


def _scaled(tree: Tree | float, by: float) -> Tree | float:
    return (tree[0], tree[1], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed labels."""
    pos = y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    z = np.stack([margin, np.ones(len(margin))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (p - t))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def sql(tree: Tree | float, names: list[str], row: str) -> str:
    """The tree as nested CASE over the fields of a struct `row`."""
    if not isinstance(tree, tuple):
        return f"{tree:.8f}D"
    return f"CASE WHEN {row}.{names[tree[0]]} <= {tree[1]:.6f}D THEN {sql(tree[2], names, row)} ELSE {sql(tree[3], names, row)} END"


def total(trees: list, names: list[str], row: str) -> str:
    """The sum of the trees' values, as SQL."""
    return "(" + " + ".join(sql(t, names, row) for t in trees) + ")"
