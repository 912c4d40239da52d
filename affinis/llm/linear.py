"""Sparse linear hinge-loss models by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows, values, labels, dim, *, cost=1.0, epochs=20, seed=7, tolerance=1e-3):
    """w, b minimising |w|^2/2 + sum C_i * max(0, 1 - y_i (w.x_i + b)).

    rows: index arrays without repeats; values: their values (or one number for all); labels: -1 or 1.
    C_i balances the classes. The bias is a feature of value 1. Deterministic for given input order.
    """
    y = np.asarray(labels, np.float64)
    n = len(y)
    w, b, alpha = np.zeros(dim), 0.0, np.zeros(n)
    share = {s: max(1, int((y == s).sum())) for s in (-1.0, 1.0)}
    limit = np.array([cost * n / (2.0 * share[s]) for s in y])
    norms = np.array([float(np.sum(np.square(v) * (len(r) if np.ndim(v) == 0 else 1))) + 1.0 for r, v in zip(rows, values, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            idx, v = rows[i], values[i]
            gradient = y[i] * (float(np.sum(w[idx] * v)) + b) - 1.0
            if (alpha[i] <= 0 and gradient >= 0) or (alpha[i] >= limit[i] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[idx] += step * v
            b += step
        if worst < tolerance:
            break
    return w, b
