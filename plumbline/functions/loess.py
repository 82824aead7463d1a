"""Seasonal-trend decomposition by LOESS of evenly spaced series (Cleveland et al. 1990)
and its version for several seasons (Bandara et al. 2021)."""

from __future__ import annotations

import numpy as np

CELLS = 1_000_000  # neighbourhood cells held at once


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray, across: bool = True) -> np.ndarray:
    """Local linear fits at positions `at` of a series at 0..n-1, each over its `span` nearest
    points. `y` and `weights` may hold several series of equal length as columns; sums run across them, or, if not `across`, within
    each in the order that it has alone, so that its fits are the same to the last bit whatever stands beside it."""
    n, q = len(y), min(span, len(y))
    several = y.ndim == 2
    y, weights = y.reshape(n, -1), weights.reshape(n, -1)
    out = np.empty((len(at), y.shape[1]))
    rows = max(1, CELLS // (q * y.shape[1]))
    if not across:
        y, weights = np.ascontiguousarray(y.T), np.ascontiguousarray(weights.T)
    for lo in range(0, len(at), rows):
        x = at[lo : lo + rows].astype(float)
        start = np.clip(x - (q - 1) // 2, 0, n - q).astype(int)
        near = start[:, None] + np.arange(q)
        offset = near - x[:, None]
        reach = np.maximum(x - start, start + q - 1 - x) + max(0, (span - n) // 2)
        closeness = (1 - np.clip(np.abs(offset) / (np.maximum(reach, 1e-9)[:, None] * 1.001), 0, 1) ** 3) ** 3
        if across:
            axis, offset, closeness, beside, points = 1, offset[:, :, None], closeness[:, :, None], weights[near], y[near]
        else:
            axis, beside, points = 2, weights.take(near, axis=1), y.take(near, axis=1)
        w = closeness * beside
        w = w / w.sum(axis, keepdims=True)
        mean_x, mean_y = (w * offset).sum(axis), (w * points).sum(axis)
        spread = (w * offset**2).sum(axis) - mean_x**2
        slope = ((w * offset * points).sum(axis) - mean_x * mean_y) / np.where(spread > 1e-12, spread, np.inf)
        fits = mean_y - slope * mean_x
        out[lo : lo + rows] = fits if across else fits.T
    return out if several else out[:, 0]


def _smooth(y: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """LOESS of each column at every (span / 10)-th position and the last, straight lines in between."""
    n = len(y)
    at = np.unique(np.append(np.arange(0, n, max(1, -(-span // 10))), n - 1))
    fits = loess(y, span, at, weights, across=False)
    if len(at) == 1:
        return np.repeat(fits, n, axis=0)
    x = np.arange(n)
    j = np.minimum(np.searchsorted(at, x, side="right") - 1, len(at) - 2)
    out = ((fits[1:] - fits[:-1]) / np.diff(at)[:, None])[j] * (x - at[j])[:, None] + fits[j]
    out[-1] = fits[-1]
    return out


def _odd(x: float) -> int:
    return int(np.ceil(x)) // 2 * 2 + 1


def _average(y: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([np.zeros((1, y.shape[1])), np.cumsum(y, axis=0)])
    return (total[width:] - total[:-width]) / width


def _bisquare(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of residuals of these sizes, columns where they are all alike), a series a column.

    Never quite zero: where all neighbours are outliers, they are all there is, the smaller ones first."""
    scale = 6 * np.median(size, axis=0)
    alike = scale <= 0
    ratio = size / np.where(alike, 1.0, scale)
    return np.maximum(np.clip(1 - ratio**2, 0, 1) ** 2, 1e-12 / (1 + ratio) ** 2), alike


def _rough_weights(y: np.ndarray, width: int = 15) -> np.ndarray:
    """Weights to start with: by the distance from a running median, which single points do not move. A first fit
    with equal weights would spread a spike over its neighbours, and all would be weighed down together."""
    half = width // 2
    padded = np.pad(y, ((half, half), (0, 0)), mode="reflect" if len(y) > half else "edge")
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=0)
    weights, alike = _bisquare(np.abs(y - np.median(around, axis=-1)))
    return np.where(alike, 1.0, weights)


def stl(y: np.ndarray, period: int, seasonal: int = 7, outer: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend), with a robust start and `outer` rounds of down-weighting large residuals. `y` may hold several
    series of equal length as columns; each is decomposed by itself and leaves the rounds when it is done."""
    n = len(y)
    if n <= 2 * period:
        raise ValueError(f"{n} points are too few for a season of {period}")
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal))
    shape, y = y.shape, y.reshape(n, -1)
    seasons, trends, live = np.empty(y.shape), np.empty(y.shape), np.arange(y.shape[1])
    trend, weights = np.zeros(y.shape), _rough_weights(y)
    for round_ in range(outer + 1):
        for _ in range(2):
            rest = y - trend
            cycle = np.empty((n + 2 * period, len(live)))
            for first, last in ((0, n % period), (n % period, period)):
                if first == last:
                    continue
                # phases first..last-1 have equally many points: one column each, of each series
                length = (n - first - 1) // period + 1
                cells = np.arange(first, last) + period * np.arange(length)[:, None]
                smooth = loess(rest[cells].reshape(length, -1), seasonal, np.arange(-1, length + 1), weights[cells].reshape(length, -1))
                cycle[np.arange(first, last) + period * np.arange(length + 2)[:, None]] = smooth.reshape(length + 2, last - first, -1)
            low = _average(_average(_average(cycle, period), period), 3)
            low = _smooth(low, _odd(period), np.ones(y.shape))
            season = cycle[period:-period] - low
            trend = _smooth(y - season, trend_span, weights)
        seasons[:, live], trends[:, live] = season, trend
        if round_ < outer:
            size, seen = np.abs(y - season - trend), weights > 1e-9
            reach = np.where(seen, y, -np.inf).max(axis=0) - np.where(seen, y, np.inf).min(axis=0)
            weights, alike = _bisquare(size)
            on = ~(alike | (6 * np.median(size, axis=0) <= 1e-9 * reach))
            if not on.any():
                break
            live, y, trend, weights = live[on], y[:, on], trend[:, on], weights[:, on]
    return seasons.reshape(shape), trends.reshape(shape)


def mstl(y: np.ndarray, periods: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the seasonals, trend) of a series, or of each column; seasons are refined in turn, shortest first, twice."""
    periods = sorted(p for p in periods if 2 * p < len(y))
    if not periods:
        raise ValueError(f"{len(y)} points are too few for any of the seasons")
    seasons = [np.zeros(y.shape) for _ in periods]
    trend = np.zeros(y.shape)
    for _ in range(2 if len(periods) > 1 else 1):
        for i, period in enumerate(periods):
            others = sum(s for j, s in enumerate(seasons) if j != i)
            seasons[i], trend = stl(y - others, period, seasonal=7 + 4 * i)
    return sum(seasons), trend
