"""The exact bootstrap distribution of a median, and of the difference of two.

A resample of n draws has at most v in k or more of its places with a binomial
probability in the share of observations up to v.  That gives each middle order
statistic, and for even n both together, without a draw; quantiles of the
difference of two medians are found by bisection on the summed distribution.
"""

from __future__ import annotations

import math

import numpy as np

from plumbline.functions.dist import beta_inc

#: Standard deviations around the middle beyond which no resampled median falls.
REACH = 24.0
#: Probability below which a pair of middle draws is left out.
NOTHING = 1e-22


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _log_drop(high: np.ndarray, low: np.ndarray, power: int) -> np.ndarray:
    """log(high**power - low**power) for 0 <= low < high."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(low > 0, np.exp(power * (_log(low) - _log(high))), 0.0)
        return power * _log(high) + np.log1p(-np.minimum(share, 1.0))


def bootstrap_median(values: np.ndarray, before: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible medians of a resample and their probabilities.

    ``values`` are distinct and rising, at least all within ``REACH`` standard
    deviations of the middle; ``before`` counts the observations below each.
    """
    up_to, below = (before + counts) / n, before / n
    above, from_here = (n - before - counts) / n, (n - before) / n
    k = (n + 1) // 2

    def tail(share):
        return beta_inc(float(k), float(n - k + 1), share)

    lower = tail(up_to) - tail(below)
    if n % 2:
        support, p = values, lower
    else:
        choose = math.lgamma(n + 1) - 2 * math.lgamma(k + 1)
        first, second = _log_drop(up_to, below, k), _log_drop(from_here, above, k)
        support, p = [values], [lower - np.exp(choose + first + k * _log(above))]
        for gap in range(1, len(values)):
            if np.exp(choose + first[:-gap] + k * _log(from_here[gap:])).max() < NOTHING:
                break
            support.append((values[:-gap] + values[gap:]) / 2.0)
            p.append(np.exp(choose + first[:-gap] + second[gap:]))
        support, p = np.concatenate(support), np.concatenate(p)
    own, place = np.unique(support, return_inverse=True)
    p = np.bincount(place, np.maximum(p, 0.0), len(own))
    return own[p > 0], p[p > 0] / p.sum()


def difference_quantile(a: np.ndarray, p_a: np.ndarray, b: np.ndarray, p_b: np.ndarray, q: float) -> float:
    """The least d with P(B - A <= d) >= q for independent A and B with rising supports."""
    rising = np.concatenate(([0.0], np.cumsum(p_b)))

    def reached(d: float) -> bool:
        return float((p_a * rising[np.searchsorted(b, a + d, "right")]).sum()) >= q

    low, high = float(b[0] - a[-1]), float(b[-1] - a[0])
    if reached(low):
        return low
    while high - low > 1e-12 * max(1.0, abs(low), abs(high)):
        middle = (low + high) / 2.0
        low, high = (low, middle) if reached(middle) else (middle, high)
    after = np.searchsorted(b, a + low, "right")
    return float((b[after[after < len(b)]] - a[after < len(b)]).min())
