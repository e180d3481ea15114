"""Distribution functions for result tables (one row per test).

Spark SQL has no t, F or normal distribution.  These helpers run on numpy
arrays inside pandas UDFs and only ever see finished test statistics, so their
cost does not grow with the data.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(scalar, values) -> np.ndarray:
    values = np.asarray(values, dtype=float)
    return np.fromiter(map(scalar, values.ravel()), dtype=float, count=values.size).reshape(values.shape)


def _lgamma(values) -> np.ndarray:
    return _each(math.lgamma, values)


def _erfc(values) -> np.ndarray:
    return _each(math.erfc, values)


def norm_cdf(z) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, dtype=float) / math.sqrt(2.0))


def _beta_fraction(a, b, x, rounds: int = 400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds + 1):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1.0) / (a + b + 2.0)
    low = front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, inner, 1.0 - inner))
    value = np.where(direct, low / a, 1.0 - low / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, df1, df2) -> np.ndarray:
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_quantile(p, df) -> np.ndarray:
    """Upper quantile: the t with two-sided tail mass 2 * (1 - p), p > 0.5."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    low, high = np.zeros(p.shape), np.full(p.shape, 1e7)
    target = 2.0 * (1.0 - p)
    for _ in range(120):
        middle = 0.5 * (low + high)
        above = t_two_sided(middle, df) > target
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def t_test_power(effect, n1, ratio, alpha) -> np.ndarray:
    """Two-sided power of the pooled t test from the non-central t distribution.

    T = (Z + shift) / S with S**2 a scaled chi-square, so the power is the
    normal rejection probability averaged over the density of S.
    """
    effect, n1, ratio, alpha = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (effect, n1, ratio, alpha)))
    n2 = n1 * ratio
    df = n1 + n2 - 2.0
    valid = (df > 0) & np.isfinite(effect)
    df = np.where(valid, df, 1.0)
    shift = np.abs(effect) * np.sqrt(np.where(valid, n1 * n2 / (n1 + n2), 1.0))
    critical = t_quantile(1.0 - alpha / 2.0, df)
    nodes, weights = np.polynomial.legendre.leggauss(200)
    spread = 10.0 / np.sqrt(2.0 * df)
    low, high = np.maximum(1e-9, 1.0 - spread), 1.0 + spread
    s = low[..., None] + (high - low)[..., None] * (nodes + 1.0) / 2.0
    d = df[..., None]
    log_density = (
        math.log(2.0) + (d / 2.0) * np.log(d / 2.0) - _lgamma(d / 2.0) + (d - 1.0) * np.log(s) - d * s * s / 2.0
    )
    c, h = critical[..., None], shift[..., None]
    reject = norm_cdf(h - c * s) + norm_cdf(-h - c * s)
    power = np.sum(weights * np.exp(log_density) * reject, axis=-1) * (high - low) / 2.0
    return np.where(valid, np.clip(power, 0.0, 1.0), 0.0)


# MacKinnon's published coefficients for the Dickey-Fuller
# statistic with a constant (p-value polynomials and 5 % critical value).
_DF_SPLIT, _DF_MIN, _DF_MAX = -1.61, -18.83, 2.74
_DF_SMALL = (2.1659, 1.4412, 0.038269)
_DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
DF_CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.04)


def dickey_fuller_p(tau) -> np.ndarray:
    tau = np.asarray(tau, dtype=float)
    small = sum(c * tau**i for i, c in enumerate(_DF_SMALL))
    large = sum(c * tau**i for i, c in enumerate(_DF_LARGE))
    p = norm_cdf(np.where(tau <= _DF_SPLIT, small, large))
    return np.where(tau > _DF_MAX, 1.0, np.where(tau < _DF_MIN, 0.0, p))


# Wichura's published approximation of the normal quantile (AS 241),
# numerators and denominators from the highest power down; around the middle,
# in the tails, and far out.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
NORMAL_QUANTILE = (_MIDDLE, _TAIL, _FAR)


def normal_quantile(p: Column) -> Column:
    """z with normal probability p below it, as a plain expression; null outside 0 < p < 1."""

    def fraction(parts, r: Column) -> Column:
        top, bottom = (reduce(lambda total, c: total * r + F.lit(c), parts_of[1:], F.lit(parts_of[0])) for parts_of in parts)
        return top / bottom

    middle, tail, far = NORMAL_QUANTILE
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    out = F.when(r <= 5.0, fraction(tail, r - 1.6)).otherwise(fraction(far, r - 5.0))
    z = F.when(F.abs(q) <= 0.425, q * fraction(middle, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * out)
    return F.when((p > 0) & (p < 1), z)


def _guarded(compute, *columns: pd.Series) -> pd.Series:
    """Rows with a missing or undefined argument give null."""
    frame = pd.concat([c.astype(float) for c in columns], axis=1)
    ok = np.isfinite(frame.to_numpy()).all(axis=1)
    out = pd.Series(np.full(len(frame), None), index=frame.index, dtype=object)
    if ok.any():
        out[ok] = compute(*(frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])))
    return out.astype("Float64") if ok.all() else out


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _guarded(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _t_q(p: pd.Series, df: pd.Series) -> pd.Series:
    return _guarded(t_quantile, p, df)


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _guarded(f_upper, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return _guarded(lambda v: 2.0 * norm_cdf(-np.abs(v)), z)


@F.pandas_udf(T.DoubleType())
def _power(effect: pd.Series, n1: pd.Series, ratio: pd.Series, alpha: pd.Series) -> pd.Series:
    return _guarded(t_test_power, effect, n1, ratio, alpha)


@F.pandas_udf(T.DoubleType())
def _df_p(tau: pd.Series) -> pd.Series:
    return _guarded(dickey_fuller_p, tau)


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p(t.cast("double"), df.cast("double"))


def t_critical(alpha: float, df: Column) -> Column:
    return _t_q(F.lit(1.0 - alpha / 2.0), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    return _f_p(f.cast("double"), df1.cast("double"), df2.cast("double"))


def z_p_value(z: Column) -> Column:
    return _z_p(z.cast("double"))


def power_value(effect: Column, n1: Column, ratio: Column, alpha: float) -> Column:
    return _power(effect.cast("double"), n1.cast("double"), ratio.cast("double"), F.lit(alpha))


def dickey_fuller_p_value(tau: Column) -> Column:
    return _df_p(tau.cast("double"))
