"""Small logistic models, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_sparse(
    index: np.ndarray, value: np.ndarray, ends: np.ndarray, target: np.ndarray, size: int, rounds: int = 120
) -> np.ndarray:
    """Weights and, last, the bias of a logistic model for targets in [0, 1]; rows are flat (index, value) runs."""
    weights = np.zeros(size + 1)
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights[index] * value, minlength=len(ends)) + weights[-1]
        error = (sigmoid(score) - target) / len(target)
        gradient = np.append(np.bincount(index, error[row] * value, minlength=size), error.sum())
        gradient[:-1] += 1e-6 * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return weights


def fit_dense(rows: np.ndarray, target: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a logistic model, by Newton's method with a penalty on the weights."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(len(rows), 1))
    for _ in range(rounds if len(rows) else 0):
        p = sigmoid(x @ weights)
        gradient = x.T @ (p - target) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        weights -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights
