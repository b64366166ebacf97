"""Small logistic models, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np

from factgraph.llm.words import mix


def folds(keys: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A fold for each row: each class is dealt out in the order of its keys' hashes."""
    out = np.zeros(len(y), np.int64)
    order = np.argsort(mix(np.asarray(keys).astype(np.int64).view(np.uint64)), kind="stable")
    for kind in np.unique(y):
        own = order[y[order] == kind]
        out[own] = np.arange(len(own)) % n
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def margins(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Row sums of value * weights[index] for rows in compressed form; empty rows give 0."""
    sums = np.concatenate(([0.0], np.cumsum(value * weights[index], dtype=np.float64)))
    return sums[indptr[1:]] - sums[indptr[:-1]]


def fit(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, dim: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model (full-batch Adam, classes weighed alike in the bias start)."""
    weights, rows = np.zeros(dim), np.repeat(np.arange(len(y)), np.diff(indptr))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, steps + 1):
        wrong = (sigmoid(margins(indptr, index, value, weights) + bias) - y) / len(y)
        grad, gb = np.bincount(index, value * wrong[rows], dim) + l2 * weights, wrong.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        weights -= rate * (m / a) / (np.sqrt(v / b) + 1e-10)
        bias -= min(rate, 0.1) * (mb / a) / (np.sqrt(vb / b) + 1e-10)
    return weights, bias


def platt(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """a, b so that sigmoid(a * score + b) is the chance of y, by Newton's method with halved steps and smoothed targets; ``n``: how often each row counts."""
    n = np.ones(len(y)) if n is None else n
    n1 = (n * y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n.sum() - n1 + 2))
    scale = max(float(np.abs(score).max(initial=0)), 1e-9)
    x, theta = np.column_stack((score / scale, np.ones(len(score)))), np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((n * (np.logaddexp(0, z) - target * z)).sum() + 5e-5 * (t @ t))

    now = loss(theta)
    for _ in range(100):
        p = sigmoid(x @ theta)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (n * (p - target)) + 1e-4 * theta)
        size = 1.0
        while size > 1e-9 and (new := loss(theta - size * step)) > now:
            size /= 2
        if size <= 1e-9 or now - new < 1e-10 * (1 + abs(now)):
            break
        theta, now = theta - size * step, new
    return float(theta[0] / scale), float(theta[1])
