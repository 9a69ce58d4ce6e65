"""Small linear classifiers fitted on the driver from bounded samples or histograms."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(features: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps on soft targets; the last weight is the constant."""
    wide = np.column_stack([features, np.ones(len(features))]).astype(float)
    each = np.ones(len(wide)) if weight is None else weight
    weights = np.zeros(wide.shape[1])
    penalty = np.full(wide.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        guess = sigmoid(wide @ weights)
        slope = wide.T @ (each * (guess - target)) + penalty * weights
        curve = (wide * (each * guess * (1 - guess))[:, None]).T @ wide + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights
