"""Logistic regression in numpy, for models that are fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps, drawn towards ``prior`` where rows say little.

    weight: how often each row counts.  Without rows, or with rows of one class only, the prior and the share of ones decide."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    pull = np.full(len(w), strength)
    pull[-1] = 0.01
    own = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(ones @ w)
        slope = ones.T @ ((p - y) * own) + pull * (w - prior)
        curve = (ones * (p * (1 - p) * own)[:, None]).T @ ones + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w
