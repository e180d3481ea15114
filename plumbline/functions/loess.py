"""LOESS on evenly spaced points and the inner steps of a seasonal-trend decomposition.

Arrays may be a piece of a longer series; ``total`` is then the length of the
whole.  Near the ends of a piece that are no ends of the series the results are
those of a shorter series, so pieces carry a halo (``halo``) that is thrown away.
"""

from __future__ import annotations

import numpy as np

#: Rows of a piece whose windows are laid out at a time.
ROWS = 8_192


def _fit(at: np.ndarray, left: np.ndarray, width: int, y: np.ndarray, weights: np.ndarray | None, h: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Local lines at positions ``at`` over ``width`` points from ``left`` on, and where all weights are zero."""
    place = left[:, None] + np.arange(width)
    apart = np.abs(place - at[:, None])
    w = np.where(apart <= 0.001 * h[:, None], 1.0, (1.0 - np.minimum(apart / h[:, None], 1.0) ** 3) ** 3)
    w[apart > 0.999 * h[:, None]] = 0.0
    if weights is not None:
        w = w * weights[place]
    size = w.sum(axis=1)
    empty = size <= 0
    w = w / np.where(empty, 1.0, size)[:, None]
    offset = place - at[:, None]
    middle = (w * offset).sum(axis=1)
    spread = (w * (offset - middle[:, None]) ** 2).sum(axis=1)
    sloped = np.sqrt(spread) > 0.001 * (total - 1.0)
    slope = np.where(sloped, -middle / np.where(sloped, spread, 1.0), 0.0)
    w = w * (slope[:, None] * (offset - middle[:, None]) + 1.0)
    return (w * y[place]).sum(axis=1), empty


def _reach(at: np.ndarray, left: np.ndarray, width: int, window: int, n: int) -> np.ndarray:
    h = np.maximum(at - left, left + width - 1 - at).astype(float)
    return np.maximum(h + ((window - n) // 2 if window > n else 0), 1e-300)


def loess(y: np.ndarray, window: int, total: int | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Smooth values at every point: tricube weights over the ``window`` nearest points, straight lines.

    A point without any weight keeps its value.  The slope is used where the
    spread of the weights exceeds a thousandth of the length of the series.
    """
    n = len(y)
    total = n if total is None else total
    if n < 2:
        return y.copy()
    width = min(window, n)
    out = np.empty(n)
    for start in range(0, n, ROWS):
        at = np.arange(start, min(n, start + ROWS))
        left = np.clip(at - (window + 1) // 2 + 1, 0, n - width)
        fit, empty = _fit(at, left, width, y, weights, _reach(at, left, width, window, n), total)
        out[at] = np.where(empty, y[at], fit)
    return out


def _beyond(y: np.ndarray, window: int, total: int, weights: np.ndarray | None) -> tuple[float, float]:
    """The smooth one step before the first and one after the last point."""
    n = len(y)
    width = min(window, n)
    at, left = np.array([-1, n]), np.array([0, n - width])
    fit, empty = _fit(at, left, width, y, weights, _reach(at, left, width, window, n), total)
    return float(y[0] if empty[0] else fit[0]), float(y[-1] if empty[1] else fit[1])


def _mean(x: np.ndarray, width: int) -> np.ndarray:
    sums = np.cumsum(np.concatenate(([0.0], x - x.mean())))
    return (sums[width:] - sums[:-width]) / width + x.mean()


def _odd(x: float) -> int:
    """The least odd integer that is not below x."""
    n = int(np.ceil(x))
    return n + 1 - n % 2


def windows(period: int, seasonal: int = 7) -> tuple[int, int, int]:
    """Windows of the seasonal, trend and low-pass smooths."""
    return seasonal, _odd(1.5 * period / (1.0 - 1.5 / seasonal)), _odd(period + 1)


def halo(period: int, inner: int = 2, seasonal: int = 7) -> int:
    """Points, in whole periods, beyond which nothing bears on a point in ``inner`` steps."""
    cycle, trend, low = windows(period, seasonal)
    return (inner * (((cycle + 1) // 2 + 2) * period + (trend + low) // 2 + 4) // period + 1) * period


def inner_step(y: np.ndarray, trend: np.ndarray, weights: np.ndarray | None, period: int, seasonal: int = 7, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Season and trend after one step; a piece starts at a multiple of the period."""
    n, total = len(y), len(y) if total is None else total
    cycle, long, low = windows(period, seasonal)
    detrended = y - trend
    cycles = np.empty(n + 2 * period)
    for phase in range(period):
        own = detrended[phase::period]
        rw = None if weights is None else weights[phase::period]
        whole = (total - phase - 1) // period + 1
        first, last = _beyond(own, cycle, whole, rw)
        cycles[phase::period][: len(own) + 2] = np.concatenate(([first], loess(own, cycle, whole, rw), [last]))
    level = _mean(_mean(_mean(cycles, period), period), 3)
    season = cycles[period : period + n] - loess(level, low, total)
    return season, loess(y - season, long, total, weights)


def bisquare(residuals: np.ndarray, median: float) -> np.ndarray:
    """Robustness weights from the median of the absolute residuals."""
    if median == 0:
        return np.ones(len(residuals))
    share = np.abs(residuals) / (6.0 * median)
    w = (1.0 - np.minimum(share, 1.0) ** 2) ** 2
    return np.where(share <= 0.001, 1.0, np.where(share <= 0.999, w, 0.0))


def decompose(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and last robustness weights of a whole series."""
    trend, weights, season = np.zeros(len(y)), None, np.zeros(len(y))
    for k in range(outer + 1):
        for _ in range(inner):
            season, trend = inner_step(y, trend, weights, period, seasonal)
        if k < outer:
            residuals = np.abs(y - season - trend)
            weights = bisquare(residuals, float(np.median(residuals)))
    return season, trend, weights if weights is not None else np.ones(len(y))
