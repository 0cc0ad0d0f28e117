"""A small linear support vector machine on sparse rows, and a logistic calibration of its margins."""

from __future__ import annotations

import numpy as np


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: float = 1.0, epochs: int = 25, seed: int = 7, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss.

    rows: (indices, values) each, with no index twice in a row; y: +1 or -1; weight: a cost factor for each row.
    Returns the weights and the bias (a constant feature of value 1). The order of visits is seeded: reruns agree.
    """
    w, b, n = np.zeros(width), 0.0, len(rows)
    alpha, cost = np.zeros(n), c * (np.ones(n) if weight is None else weight)
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            slack = 0.5 / cost[i]
            g = y[i] * (w[at] @ v + b) - 1.0 + slack * alpha[i]
            if alpha[i] == 0.0 and g >= 0.0:
                continue
            new = max(0.0, alpha[i] - g / (square[i] + slack))
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(g))
                w[at] += step * v
                b += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, b


def train_dense(x: np.ndarray, y: np.ndarray, c: float = 1.0, weight: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, float]:
    """The same machine on few dense features, in the primal, by Newton steps over the rows within the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    cost = c * (np.ones(len(x)) if weight is None else weight)
    w = np.zeros(x1.shape[1])
    ridge = np.ones(x1.shape[1])
    ridge[-1] = 1e-3
    margin = np.zeros(len(x))
    loss = lambda v, m: float(ridge @ (v * v)) + float(cost @ np.maximum(0.0, 1 - y * m) ** 2)
    now = loss(w, margin)
    for _ in range(rounds):
        inside = y * margin < 1
        near = x1[inside]
        a = near * cost[inside, None].astype(np.float32)
        step = np.linalg.solve((a.T @ near).astype(np.float64) + np.diag(ridge), (a.T @ y[inside].astype(np.float32)).astype(np.float64)) - w
        along = (x1 @ step.astype(np.float32)).astype(np.float64)
        t, new = 1.0, loss(w + step, margin + along)
        while new > now and t > 1e-4:
            t /= 2
            new = loss(w + t * step, margin + t * along)
        if now - new < 1e-4 * max(1.0, now):
            break
        w, margin, now = w + t * step, margin + t * along, new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(positive) = 1 / (1 + exp(-(slope * margin + offset))), by Newton steps on smoothed targets."""
    n1, n0 = float(positive.sum()), float((~positive).sum())
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([d @ margin + 1e-3 * a, d.sum() + 1e-3 * b])
        hess = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def logistic(x: np.ndarray, positive: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> tuple[float, ...]:
    """Weights of P(positive) = 1 / (1 + exp(-(x @ w + b))) and b, by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = np.inf  # a column that doesn't vary tells nothing
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (p - positive) + keep @ w)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / scale
    return (*own.tolist(), float(w[-1] - own @ mean))
