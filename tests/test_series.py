"""Lags by information criterion, LOESS and robust decomposition, normality and exact median intervals."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist, loess, medians
from plumbline.operators import compare, dispatch, series

RNG = np.random.default_rng(11)


def frame(spark, named):
    rows = [(s, int(i), None if v is None else float(v)) for s, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, t int, v double").repartition(7)


def brute_adf(y):
    """Every number of lags by least squares, then the best one on all rows it can use."""
    y = y - y.mean()
    n, dy = len(y), np.diff(y)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def fit(lags, skip):
        t = np.arange(skip, n - 1)
        x = np.column_stack([np.ones(len(t)), y[t], *[dy[t - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
        rss = ((dy[t] - x @ beta) ** 2).sum()
        return beta, rss, x, len(t)

    scores = []
    for lags in range(most + 1):
        _, rss, _, m = fit(lags, most)
        scores.append(m * math.log(rss / m) + 2 * (lags + 2))
    best = int(np.argmin(scores))
    beta, rss, x, m = fit(best, best)
    error = math.sqrt(rss / (m - best - 2) * np.linalg.inv(x.T @ x)[1, 1])
    return best, m, beta[1] / error


def test_lags_with_the_least_aic_in_any_blocks(spark):
    noise = RNG.normal(0, 1, 700)
    lagged = np.zeros(700)
    for i in range(5, 700):
        lagged[i] = 0.5 * lagged[i - 1] - 0.4 * lagged[i - 2] + 0.3 * lagged[i - 5] + noise[i]
    named = {"walk": RNG.normal(0, 1, 400).cumsum() + 1e6, "lagged": lagged, "white": RNG.normal(5, 2, 90), "tiny": RNG.normal(0, 1, 25)}
    points = frame(spark, named | {"flat": [3.0] * 60, "short": [1.0, 2.0, 1.0]})
    for block in (10_000, 64, 7):
        found = {r.s: r for r in series.adf_test(points, ["s"], "t", "v", 12, block=block).collect()}
        for s, y in named.items():
            lags, m, tau = brute_adf(np.asarray(y))
            assert (found[s].used_lag, found[s].m) == (lags, m), (s, block)
            assert found[s].tau == pytest.approx(tau, rel=1e-6)
        assert found["flat"].status == "ok" and found["flat"].tau is None and found["flat"].is_stationary is None
        assert found["short"].status == "error"


def brute_loess(y, window, weights=None):
    n = len(y)
    out = []
    for i in range(n):
        width = min(window, n)
        left = min(max(i - (window + 1) // 2 + 1, 0), n - width)
        h = max(i - left, left + width - 1 - i) + (max(0, window - n) // 2)
        w = []
        for j in range(left, left + width):
            r = abs(j - i)
            own = 1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3 if r <= 0.999 * h else 0.0
            w.append(own * (1.0 if weights is None else weights[j]))
        total = sum(w)
        if total <= 0:
            out.append(y[i])
            continue
        w = [a / total for a in w]
        x = range(left, left + width)
        a = sum(p * j for p, j in zip(w, x, strict=True))
        c = sum(p * (j - a) ** 2 for p, j in zip(w, x, strict=True))
        slope = (i - a) / c if math.sqrt(c) > 0.001 * (n - 1) else 0.0
        out.append(sum(p * (1 + slope * (j - a)) * y[j] for p, j in zip(w, x, strict=True)))
    return out


@pytest.mark.parametrize(("n", "window"), [(60, 7), (60, 25), (20, 31), (2, 7), (1, 7)])
def test_loess_point_by_point(n, window):
    y, weights = RNG.normal(0, 1, n), RNG.random(n)
    assert np.allclose(loess.loess(y, window), brute_loess(y, window))
    assert np.allclose(loess.loess(y, window, weights=weights), brute_loess(y, window, weights))
    weights[: n // 2] = 0
    assert np.allclose(loess.loess(y, window, weights=weights), brute_loess(y, window, weights))


def test_smooth_does_not_depend_on_blocks(spark):
    named = {"a": RNG.normal(0, 1, 300).cumsum(), "b": RNG.normal(0, 1, 40), "c": [5.0]}
    whole, cut = ({(r.s, r.t): r.smooth for r in series.loess_smooth(frame(spark, named), ["s"], "t", "v", 15, 2, block).collect()} for block in (10_000, 16))
    assert whole.keys() == cut.keys() and len(whole) == 341
    assert all(whole[k] == pytest.approx(cut[k], abs=1e-9) for k in whole)


def test_decomposition_does_not_depend_on_blocks(spark):
    t = np.arange(900)
    y = 5 * np.sin(2 * np.pi * t / 6) + t / 100 + RNG.normal(0, 0.4, 900)
    y[[100, 400, 401]] += 40
    named = {"long": y, "short": y[:100], "less": y[:9]}
    whole, cut = ({(r.s, r.t): r for r in series.stl(frame(spark, named), ["s"], "t", "v", 6, outer=3, block=block).collect()} for block in (10_000, 120))
    season, trend, weights = loess.decompose(y, 6, outer=3)
    assert whole.keys() == cut.keys() and {s for s, _ in whole} == {"long", "short"}
    for k, r in whole.items():
        assert (r.season, r.trend, r.weight) == pytest.approx((cut[k].season, cut[k].trend, cut[k].weight), abs=1e-8)
    for i in range(900):
        assert (whole["long", i].season, whole["long", i].trend) == pytest.approx((season[i], trend[i]))
        assert whole["long", i].resid == pytest.approx(y[i] - season[i] - trend[i])
    assert all(whole["long", i].weight < 0.01 for i in (100, 400, 401))


def test_outliers_do_not_hide_a_season(spark):
    t = np.arange(240)
    y = 10 * np.sin(2 * np.pi * t / 12) + RNG.normal(0, 0.5, 240)
    season, _, weights = loess.decompose(y, 12)
    spoilt = y.copy()
    spoilt[::31] += 300
    again, _, _ = loess.decompose(spoilt, 12)
    assert np.abs(season - 10 * np.sin(2 * np.pi * t / 12)).mean() < 0.5
    assert np.abs(again - season).mean() < 0.5 and weights.mean() > 0.8
    rows = {"season": y, "noise": RNG.normal(0, 1, 240)}
    found = {r.s: r.seasonal_strength for r in series.robust_strength(frame(spark, rows), ["s"], "t", "v", 12).collect()}
    assert found["season"] > 0.95 and found["noise"] < 0.7


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 0.001, 0.0749, 0.0751, 0.5, 0.6, 0.999999]
    rows = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0]], "p double").select(dist.normal_quantile(F.col("p")).alias("z")).collect()
    for x, r in zip(p, rows, strict=False):
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(x), rel=1e-12, abs=1e-12)
    assert [r.z for r in rows[len(p) :]] == [None, None]


def test_normality_by_normal_scores(spark):
    normal, skewed = RNG.normal(50, 5, 400), RNG.exponential(5, 6_000)
    rows = [("g", float(v), False) for v in normal] + [("g", float(v), True) for v in skewed] + [("few", float(v), v > 2) for v in range(6)]
    df = spark.createDataFrame(rows, "g string, v double, b boolean")
    sides = compare.side_ranks(compare.value_counts(df, "v", F.col("b"), ["g"]), ["g"])
    found = {r.g: r for r in compare.shapiro_francia(sides, ["g"]).collect()}
    order = np.sort(normal)
    scores = np.array([statistics.NormalDist().inv_cdf((i - 0.375) / 400.25) for i in range(1, 401)])
    assert found["g"].w_a == pytest.approx(np.corrcoef(order, scores)[0, 1] ** 2)
    assert found["g"].p_normal_a > 0.01 and found["g"].p_normal_b < 1e-6 and not found["g"].is_normal
    assert found["few"].is_normal and found["few"].p_normal_a is None


def test_p_of_normal_samples_is_spread_evenly(spark):
    rows = [(k, float(v), False) for k in range(400) for v in RNG.normal(0, 1, 60)]
    df = spark.createDataFrame(rows, "g int, v double, b boolean")
    sides = compare.side_ranks(compare.value_counts(df, "v", F.col("b"), ["g"]), ["g"])
    p = [r.p_normal_a for r in compare.shapiro_francia(sides, ["g"]).collect()]
    assert 0.02 < np.mean(np.array(p) < 0.05) < 0.09 and 0.4 < np.mean(p) < 0.6


def brute_medians(values):
    """Every resample of a small sample."""
    counts = {}
    for draw in itertools.product(values, repeat=len(values)):
        m = statistics.median(draw)
        counts[m] = counts.get(m, 0) + 1
    total = sum(counts.values())
    return {m: c / total for m, c in counts.items()}


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 8.0], [1.0, 2.0, 4.0, 8.0, 16.0], [3.0, 3.0, 5.0, 7.0], [1.0, 1.0, 1.0], [2.0], [1.0, 9.0], [1.0, 2.0, 2.0, 3.0, 3.0, 9.0]])
def test_distribution_of_a_resampled_median(values):
    own, counts = np.unique(values, return_counts=True)
    support, p = medians.bootstrap_median(own, np.cumsum(counts) - counts, counts.astype(float), len(values))
    expected = brute_medians(values)
    got = {float(s): float(q) for s, q in zip(support, p, strict=True) if q > 1e-13}
    assert got == pytest.approx(expected, abs=1e-12)


def test_quantiles_of_a_difference(spark):
    rng = random.Random(2)
    a, b = [rng.randrange(20) / 2 for _ in range(5)], [rng.randrange(20) / 2 for _ in range(4)]
    pairs = {}
    for (x, p), (y, q) in itertools.product(brute_medians(a).items(), brute_medians(b).items()):
        pairs[y - x] = pairs.get(y - x, 0) + p * q
    ordered = sorted(pairs)

    def quantile(q):
        return next(d for i, d in enumerate(ordered) if sum(pairs[e] for e in ordered[: i + 1]) >= q - 1e-12)

    rows = [(None, v, False) for v in a] + [(None, v, True) for v in b] + [("one side", 1.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, b boolean")
    sides = compare.side_ranks(compare.value_counts(df, "v", F.col("b"), ["g"]), ["g"])
    found = {r.g: r for r in compare.exact_median_ci(sides, ["g"], 0.1).collect()}
    assert (found[None].ci_lower, found[None].ci_upper) == pytest.approx((quantile(0.05), quantile(0.95)))
    assert found["one side"].ci_lower is None


def test_median_of_a_large_sample_is_narrow():
    n = 4_000_000
    middle = np.arange(n // 2 - 30_000, n // 2 + 30_000, dtype=float)
    support, p = medians.bootstrap_median(middle, middle, np.ones(len(middle)), n)
    mean = (support * p).sum()
    assert p.sum() == pytest.approx(1.0) and mean == pytest.approx(n / 2 - 0.5, abs=1)
    assert math.sqrt(((support - mean) ** 2 * p).sum()) == pytest.approx(math.sqrt(n) / 2, rel=1e-3)


def test_differences_where_an_order_is_given(spark):
    rows = [(i, float(i % 7), float(i % 7 * 2 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, y double").repartition(5)
    asked = [dispatch.Hypothesis("plain", "association", "x", "y"), dispatch.Hypothesis("ordered", "association", "x", "y", options={"order": ("i",)})]
    found = {r.hypothesis_id: r for r in dispatch.default_registry().run(df, asked).collect()}
    x, y = (np.array([r[k] for r in rows]) for k in (1, 2))
    assert found["ordered"].result["diff_pearson_r"] == pytest.approx(np.corrcoef(np.diff(x), np.diff(y))[0, 1])
    assert "diff_pearson_r" not in found["plain"].result and found["plain"].result["pearson_r"] == found["ordered"].result["pearson_r"]
