"""Small numpy learners for bounded training samples."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30
             ) -> np.ndarray:
    """Weights of a logistic model with an unpenalised bias in front, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def adagrad(gradient, size: int, steps: int, rate: float = 0.5) -> np.ndarray:
    """Weights that follow the negative gradient with a step size per weight."""
    w, squares = np.zeros(size), np.full(size, 1e-8)
    for _ in range(steps):
        g = gradient(w)
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return w
