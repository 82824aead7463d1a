"""Student-t quantiles from the incomplete beta function, for arrays."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def _upper_tail(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 1, where the continued fraction converges fast."""
    a, b = freedom / 2, 0.5
    x = freedom / (freedom + t * t)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / np.where(np.abs(1 + term * d) < tiny, tiny, 1 + term * d)
            c = np.where(np.abs(1 + term / c) < tiny, tiny, 1 + term / c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return front * h / 2


def _density(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    scale = _log_gamma((freedom + 1) / 2) - _log_gamma(freedom / 2) - 0.5 * np.log(freedom * math.pi)
    return np.exp(scale - (freedom + 1) / 2 * np.log1p(t * t / freedom))


def t_upper(tail: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """The t with P(T > t) = tail, for tails below about 0.05.

    Newton on log(tail) over log(t), a concave curve: after the first step it only comes closer.
    The start is the normal quantile, which is never above t.
    """
    t = np.array([NormalDist().inv_cdf(1 - p) for p in tail])
    for _ in range(50):
        now = _upper_tail(t, freedom)
        step = np.log(now / tail) * now / (t * _density(t, freedom))
        t = t * np.exp(step)
        if np.all(np.abs(step) < 1e-12):
            break
    return t


def esd_limits(n: int, k: int, alpha: float) -> tuple[float, ...]:
    """Critical values of the generalised ESD test (Rosner 1983) for the first k removals."""
    left = n - np.arange(1, k + 1, dtype=float)  # n - i
    t = t_upper(alpha / (2 * (left + 1)), left - 1)
    return tuple(left * t / np.sqrt((left - 1 + t * t) * (left + 1)))
