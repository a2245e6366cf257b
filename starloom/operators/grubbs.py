"""Iterative Grubbs test on a few points (one per chain), on the driver."""

from __future__ import annotations

import math

import numpy as np

from ..functions.student import t_quantile


def grubbs_critical_value(n: int, alpha: float) -> float:
    if n < 3:
        raise ValueError(f"three points are needed at least; got {n}")
    t2 = t_quantile(1 - alpha / (2 * n), n - 2) ** 2
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))


def iterative_grubbs(points: np.ndarray, *, alpha: float = 0.05, max_outliers: int = 10) -> list[int]:
    """Rows removed one by one: each time the one farthest, in any column, from the mean of those left, while it lies beyond the critical value."""
    points = np.asarray(points, float)
    if points.ndim == 1:
        points = points[:, None]
    left, gone = list(range(len(points))), []
    while len(left) >= 3 and len(gone) < max_outliers:
        own = points[left]
        spread = own.std(axis=0, ddof=1)
        far = np.where(spread > 0, np.abs(own - own.mean(axis=0)) / np.where(spread > 0, spread, 1), 0).max(axis=1)
        worst = int(far.argmax())
        if not far[worst] > grubbs_critical_value(len(left), alpha):
            break
        gone.append(left.pop(worst))
    return gone
