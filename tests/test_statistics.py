import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.functions.ordered import ordered_chunks, previous_values, running_total, suffix_min
from plumbline.operators import associate, causal, compare, discovery, series

RNG = np.random.default_rng(7)


@pytest.fixture(autouse=True, scope="module")
def many_chunks(spark):
    """Small tables would fit one chunk; keep them apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Published t, F and power table entries.
@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (2.042272, 30, 0.05), (4.032143, 5, 0.01), (12.7062, 1, 0.05)])
def test_t_tail_and_quantile(t, df, p):
    assert dist.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    assert dist.t_quantile(1 - p / 2, df) == pytest.approx(t, abs=1e-4)


def test_f_tail_and_normal():
    assert dist.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_upper(2.5**2, 1, 40) == pytest.approx(float(dist.t_two_sided(2.5, 40)), abs=1e-12)
    assert dist.norm_cdf(1.959964) == pytest.approx(0.975, abs=1e-7)


def test_power_tables():
    assert dist.t_test_power(0.5, 64, 1.0, 0.05) == pytest.approx(0.8015, abs=1e-3)
    assert dist.t_test_power(0.8, 26, 1.0, 0.05) == pytest.approx(0.8075, abs=1e-3)
    assert dist.t_test_power(0.0, 50, 1.0, 0.05) == pytest.approx(0.05, abs=1e-4)


def test_dickey_fuller_p_at_critical_values():
    assert dist.dickey_fuller_p(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert dist.dickey_fuller_p(-3.43) == pytest.approx(0.01, abs=1e-3)
    assert dist.dickey_fuller_p(5.0) == 1.0


def _skewed(spark, n=400):
    """One group holds most rows and one value a third of them."""
    rows = [("hot" if i % 10 else "cold", 7.0 if i % 3 == 0 else float(RNG.integers(0, 200)), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, i int").repartition(9)


def test_chunked_prefix_lag_and_suffix(spark):
    rows, df = _skewed(spark)
    chunks = ordered_chunks(df, ["g"], ["v", "i"])
    assert chunks.select("_chunk").distinct().count() > 1
    total = {r.i: r.s for r in running_total(chunks, ["g"], ["v", "i"], "v", "s").collect()}
    before = {r.i: r.prev_v for r in previous_values(chunks, ["g"], ["v", "i"], ["v"]).collect()}
    least = {r.i: r.m for r in suffix_min(chunks, ["g"], ["v", "i"], "i", "m").collect()}
    for g in ("hot", "cold"):
        ordered = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        running, last = 0.0, None
        for k, (_, v, i) in enumerate(ordered):
            assert total[i] == running and before[i] == last
            assert least[i] == min(r[2] for r in ordered[k:])
            running, last = running + v, v


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_mann_whitney_by_counting_pairs(spark):
    a = [float(x) for x in RNG.integers(0, 12, 60)]
    b = [float(x) for x in RNG.integers(3, 15, 45)]
    df = spark.createDataFrame([("g", v, False) for v in a] + [("g", v, True) for v in b], "g string, v double, b boolean")
    counts = compare.value_counts(df, "v", F.col("b"), ["g"])
    row = compare.mann_whitney(counts, ["g"]).first()
    u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    assert row.statistic == u
    assert row.effect_size == pytest.approx(2 * u / (60 * 45) - 1)
    n = 105
    ties = sum(t**3 - t for t in [(a + b).count(v) for v in set(a + b)])
    sigma = math.sqrt(60 * 45 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert row.z == pytest.approx((abs(u - 60 * 45 / 2) - 0.5) / sigma)
    assert row.p == pytest.approx(math.erfc(row.z / math.sqrt(2)))


def _two_samples(spark, a, b):
    return spark.createDataFrame(
        [("g", float(v), False) for v in a] + [("g", float(v), True) for v in b], "g string, v double, b boolean"
    )


def test_known_shift_is_found_by_a_t_test(spark):
    a, b = RNG.normal(100, 10, 50), RNG.normal(115, 10, 50)
    row = compare.before_after(_two_samples(spark, a, b), "v", F.col("b"), ["g"]).first()
    assert row.p < 0.05 and row.test_name.endswith("t-test") and row.effect_kind == "d"
    assert row.ci_lower < b.mean() - a.mean() < row.ci_upper
    pooled = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert row.effect_size == pytest.approx((b.mean() - a.mean()) / pooled)


def test_skewed_samples_get_ranks_and_an_interval(spark):
    a, b = RNG.exponential(10, 200), RNG.exponential(14, 201)
    row = compare.before_after(_two_samples(spark, a, b), "v", F.col("b"), ["g"]).first()
    assert row.test_name == "Mann-Whitney U" and row.effect_kind == "r"
    draws = [np.median(RNG.choice(b, 201)) - np.median(RNG.choice(a, 200)) for _ in range(3000)]
    low, high = np.percentile(draws, [2.5, 97.5])
    spread = high - low
    assert row.ci_lower == pytest.approx(low, abs=0.15 * spread)
    assert row.ci_upper == pytest.approx(high, abs=0.15 * spread)


def test_bootstrap_positions_have_the_resampling_distribution(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    counts = compare.value_counts(_two_samples(spark, [0.0] * 9, values), "v", F.col("b"), ["g"])
    sides = compare.side_ranks(counts, ["g"])
    row = compare.bootstrap_median_ci(sides, ["g"], resamples=20000).first()
    draws = np.median(RNG.choice(values, (200000, 6)), axis=1)
    assert row.resamples == 20000
    assert (row.ci_lower, row.ci_upper) == tuple(np.percentile(draws, [2.5, 97.5]))


def test_small_groups_are_errors(spark):
    row = compare.before_after(_two_samples(spark, [1, 2], [3, 4, 5, 6]), "v", F.col("b"), ["g"]).first()
    assert (row.status, row.error, row.p) == ("error", "too few rows", None)


def test_null_groups_and_one_sided_groups_stay(spark):
    rows = [(None, float(v), i % 2 == 1) for i, v in enumerate(RNG.normal(0, 1, 40))] + [("one", float(i), False) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double, b boolean")
    found = {r.g: r for r in compare.before_after(df, "v", F.col("b"), ["g"]).collect()}
    assert set(found) == {None, "one"} and found[None].status == "ok" and found[None].p is not None
    assert found["one"].status == "error" and found["one"].n_b == 0
    pairs = spark.createDataFrame([(None, float(i), float(i * i)) for i in range(10)], "g string, x double, y double")
    assert associate.spearman(pairs, "x", "y", ["g"]).first().spearman_r == pytest.approx(1.0)
    family = spark.createDataFrame([(None, 0.01), (None, None), (None, 0.02)], "family string, p double")
    assert sorted(r.q for r in discovery.bh_fdr(family, ["family"]).collect()) == pytest.approx([0.03, 0.03, 1.0])


def test_constant_samples_do_not_fail(spark):
    row = compare.before_after(_two_samples(spark, [2] * 10, [2] * 10), "v", F.col("b"), ["g"]).first()
    assert row.status == "ok" and row.p is None


def test_unequal_variances_get_welch(spark):
    a, b = RNG.normal(0, 1, 300), RNG.normal(0, 6, 300)
    counts = compare.value_counts(_two_samples(spark, a, b), "v", F.col("b"), ["g"])
    assert compare.brown_forsythe(compare.side_ranks(counts, ["g"]), ["g"]).first().equal_var is False
    moments = compare.two_sample_moments(_two_samples(spark, a, b), "v", F.col("b"), ["g"])
    row = compare.t_test(moments.withColumn("equal_var", F.lit(False))).first()
    va, vb = a.var(ddof=1) / 300, b.var(ddof=1) / 300
    assert row.df == pytest.approx((va + vb) ** 2 / (va**2 / 299 + vb**2 / 299))


def test_linear_pair_and_spearman(spark):
    x = np.arange(50.0)
    y = 2 * x + 1 + RNG.normal(0, 1, 50)
    rows = [("g", float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("g", None, 1.0, 99)]
    df = spark.createDataFrame(rows, "g string, x double, y double, i int")
    row = associate.full_association(df, "x", "y", ["g"], ["i"]).first()
    assert row.n == 50 and row.pearson_r > 0.9 and row.pearson_ci_lower < row.pearson_r < row.pearson_ci_upper
    assert row.spearman_r == pytest.approx(np.corrcoef(_ranks(list(x)), _ranks(list(y)))[0, 1])
    assert row.diff_pearson_r is None  # every step of x is equal
    assert row.pearson_p < 1e-10


def test_spearman_with_hot_value(spark):
    x = [3.0 if i % 3 == 0 else float(RNG.integers(0, 9)) for i in range(300)]
    y = [float(RNG.integers(0, 5)) + 0.3 * v for v in x]
    df = spark.createDataFrame([("g", a, b) for a, b in zip(x, y, strict=True)], "g string, x double, y double")
    r = associate.spearman(df, "x", "y", ["g"]).first().spearman_r
    assert r == pytest.approx(np.corrcoef(_ranks(x), _ranks(y))[0, 1])


def test_differences_follow_the_order_column(spark):
    x, y = RNG.normal(0, 1, 80).cumsum(), RNG.normal(0, 1, 80).cumsum()
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double").repartition(6)
    row = associate.diff_association(df, "x", "y", ["g"], ["i"]).first()
    assert row.diff_n == 79 and row.diff_pearson_r == pytest.approx(np.corrcoef(np.diff(x), np.diff(y))[0, 1])


def test_controlled_association_removes_a_confounder(spark):
    z = RNG.normal(0, 1, 400)
    w = RNG.normal(0, 1, 400)
    x, y = z + RNG.normal(0, 0.5, 400), z + 0.3 * w + RNG.normal(0, 0.5, 400)
    rows = [("g", *map(float, r)) for r in zip(x, y, z, w, strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, w double")
    row = associate.controlled_association(df, "x", "y", ["z", "w"], ["g"]).first()
    design = np.column_stack([np.ones(400), z, w])
    rx = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    ry = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert row.raw_effect > 0.7 and row.controlled_effect == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert row.attenuation_ratio == pytest.approx(abs(row.controlled_effect) / abs(row.raw_effect))
    assert row.vif_x == pytest.approx(x.var() / rx.var())
    full = np.column_stack([design, x])
    residual = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    assert row.r_squared == pytest.approx(1 - residual.var() / y.var())
    short = associate.controlled_association(df.limit(4), "x", "y", ["z", "w"], ["g"]).first()
    assert short.status == "error"


def test_series_diagnostics(spark):
    t = np.arange(240)
    seasonal = 10 * np.sin(2 * np.pi * t / 12) + RNG.normal(0, 0.5, 240)
    walk = RNG.normal(0, 1, 240).cumsum()
    rows = [("season", int(i), float(v)) for i, v in zip(t, seasonal, strict=True)]
    rows += [("walk", int(i), float(v)) for i, v in zip(t, walk, strict=True)] + [("short", i, float(i % 3)) for i in range(10)]
    points = spark.createDataFrame(rows, "s string, t int, v double")
    found = {r.s: r for r in series.analyze_timeseries(points, ["s"], "t", "v", 12, robust=False).collect()}
    assert found["season"].seasonal_strength > 0.9 and found["season"].is_stationary
    assert found["walk"].seasonal_strength < 0.6
    assert found["short"].status == "error" and found["short"].tau is None
    dy, level, ldy = np.diff(walk)[1:], walk[1:-1], np.diff(walk)[:-1]
    design = np.column_stack([np.ones(len(dy)), level, ldy])
    beta, rss, *_ = np.linalg.lstsq(design, dy, rcond=None)
    variance = rss[0] / (len(dy) - 3) * np.linalg.inv(design.T @ design)[1, 1]
    fixed = {r.s: r for r in series.adf_one_lag(points, ["s"], "t", "v", 12).collect()}
    assert fixed["walk"].tau == pytest.approx(beta[1] / math.sqrt(variance), rel=1e-9)
    assert fixed["short"].status == "error" and fixed["short"].tau is None


def _bh(ps):
    n = len(ps)
    order = sorted(range(n), key=lambda i: ps[i])
    q, low = [0.0] * n, 1.0
    for rank in range(n, 0, -1):
        low = min(low, ps[order[rank - 1]] * n / rank)
        q[order[rank - 1]] = low
    return q


def test_bh_matches_step_up(spark):
    ps = [round(float(p), 3) for p in RNG.beta(0.6, 2, 500)]
    rows = [("big", i, p) for i, p in enumerate(ps)] + [("small", i, p) for i, p in enumerate([0.001, 0.01, 0.04, 0.2, 0.5])]
    df = spark.createDataFrame(rows, "family string, i int, p double").repartition(5)
    got = {(r.family, r.i): (r.q, r.family_size) for r in discovery.bh_fdr(df, ["family"]).collect()}
    for i, q in enumerate(_bh(ps)):
        assert got["big", i] == (pytest.approx(q), 500)
    assert [got["small", i][0] for i in range(5)] == pytest.approx([0.005, 0.025, 0.04 * 5 / 3, 0.25, 0.5])
    assert discovery.bh_fdr(df.limit(0), ["family"]).count() == 0


def test_fdr_reads_every_p_key(spark):
    rows = [("r", "stat_test", {"pearson_p": 0.01}), ("r", "stat_test", {"p": 0.0}), ("r", "stat_test", {}), ("r", "sql", {"p": 0.5})]
    df = spark.createDataFrame(rows, "run_id string, kind string, result map<string,double>")
    assert sorted(r.p for r in discovery.fdr_family(df, ["run_id"]).collect()) == [0.0, 0.01, 1.0]


def _pricing_rows(n=900):
    """Confounded experiment: large customers adopt more often, true effect on the treated is known."""
    effect, rows, gains = {"L": 600.0, "M": 120.0, "S": 0.0}, [], []
    for i in range(n):
        segment = "LMMSSSSSSL"[i % 10]
        treated = int(RNG.random() < {"L": 0.7, "M": 0.5, "S": 0.25}[segment])
        organic = {"L": 400.0, "M": 100.0, "S": 10.0}[segment] + RNG.normal(0, 20)
        rows.append((segment, treated, organic + treated * effect[segment], float(RNG.integers(1, 100))))
        if treated:
            gains.append(effect[segment])
    return rows, float(np.mean(gains))


def test_stratification_beats_the_naive_estimate(spark):
    rows, truth = _pricing_rows()
    df = spark.createDataFrame(rows, "segment string, is_treated int, outcome double, lucky double")
    board = {
        r.method: r
        for r in causal.scoreboard(df, "outcome", F.col("is_treated") == 1, ["segment"], ["lucky"], truth).collect()
    }
    assert board["stratified"].absolute_error < board["naive"].absolute_error
    assert board["stratified"].violations == 0 and board["naive"].violations >= 2
    assert (board["naive"].hallucination_rate, board["stratified"].hallucination_rate) == (1.0, 0.0)


def test_strata_without_an_arm_are_left_out(spark):
    rows = [("a", 1, 5.0), ("a", 1, 7.0), ("a", 0, 1.0), ("b", 1, 100.0), ("c", 0, 1.0), ("c", 1, 2.0), ("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    row = causal.stratified_ate(df, "y", F.col("t") == 1, ["s"]).first()
    assert (row.strata, row.n_treated) == (2, 3)
    assert row.att == pytest.approx((2 * 5.0 + 1 * 0.5) / 3) and row.ate == pytest.approx((3 * 5.0 + 3 * 0.5) / 6)


def test_noise_scan_corrects(spark):
    y = RNG.normal(0, 1, 300)
    cols = {f"c{i}": RNG.normal(0, 1, 300) for i in range(20)}
    cols["real"] = y + RNG.normal(0, 0.1, 300)
    rows = [tuple(map(float, r)) for r in zip(y, *cols.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["y", *cols]))
    found = causal.noise_scan(df, list(cols), "y").collect()
    assert all(r.q >= r.p * (1 - 1e-12) for r in found)
    assert [r.candidate for r in found if r.fdr_discovery] == ["real"]
