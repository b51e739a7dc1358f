"""Sparse logistic regression with an L1 penalty and an optional counterfactual penalty."""

from __future__ import annotations

import numpy as np


def fit_logistic(
    rows: list[np.ndarray],
    y: np.ndarray,
    dim: int,
    l1: float = 1e-4,
    pairs: list[tuple[np.ndarray, np.ndarray]] | None = None,
    pull: float = 0.0,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and intercept over binary features; ``rows`` holds each row's feature ids.

    ``pairs`` has (features gained, features lost) of a row's counterfactual; ``pull`` times
    the mean squared change of score over the pairs is added to the mean log loss. Proximal
    gradient descent with momentum; deterministic.
    """
    n = len(rows)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    diffs = [(g, s) for g, s in pairs or [] if len(g) + len(s)]
    d_flat = np.concatenate([np.concatenate([g, s]) for g, s in diffs]).astype(np.int64) if diffs else None
    if diffs:
        d_sign = np.concatenate([np.concatenate([np.ones(len(g)), -np.ones(len(s))]) for g, s in diffs])
        d_owner = np.repeat(np.arange(len(diffs)), [len(g) + len(s) for g, s in diffs])
    rate = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    w, b = np.zeros(dim), float(np.log(rate / (1 - rate)))
    v, c, t = w.copy(), b, 1.0
    # a step per feature: the log loss by how often it occurs, the penalty by its curvature
    count = np.bincount(flat, minlength=dim)
    curve = np.maximum(count, 1.0) * np.sqrt(max(1.0, sizes.mean() if n else 1.0)) / max(n, 1)
    if diffs:
        width = np.array([len(g) + len(s) for g, s in diffs])
        curve = curve + 2 * pull / len(diffs) * np.bincount(d_flat, weights=width[d_owner], minlength=dim)
    step = 1 / curve
    for _ in range(steps if n else 0):
        z = np.bincount(owner, weights=v[flat], minlength=n) + c
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        grad = np.bincount(flat, weights=g[owner], minlength=dim)
        if diffs and pull:
            gap = np.bincount(d_owner, weights=d_sign * v[d_flat], minlength=len(diffs))
            grad += np.bincount(d_flat, weights=2 * pull * gap[d_owner] * d_sign / len(diffs), minlength=dim)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        bias = c - g.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # restart the momentum when it points uphill
        if np.dot(v - new, new - w) > 0:
            after = 1.0
        v, c = new + (t - 1) / after * (new - w), bias
        w, b, t = new, bias, after
    return w, b
