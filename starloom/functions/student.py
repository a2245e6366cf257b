"""Quantiles of Student's t by the regularised incomplete beta function."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_upper(t: float, dof: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * beta_share(dof / 2, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """The value that T stays below with probability p."""
    if not 0 < p < 1 or dof <= 0:
        raise ValueError("p must lie between 0 and 1 and dof be positive")
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    tail, low, high = 1 - p, 0.0, 1.0
    while t_upper(high, dof) > tail:
        low, high = high, 2 * high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_upper(mid, dof) > tail else (low, mid)
    return (low + high) / 2
