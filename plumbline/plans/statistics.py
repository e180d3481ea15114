"""Queries for statistical tests, time series, FDR and treatment effects.

The SQL side has no t or normal distribution either: p-values are checked by
Simpson integration of the density over ``generate_series``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.functions.numeric import money
from plumbline.operators import associate, causal, compare, discovery, series
from plumbline.operators.dispatch import Hypothesis, default_registry
from plumbline.plans.tables import SALES_SQL, sales, table

_SPLIT = "1998-07-01 00:00:00"
_SEGMENT = ["c_mktsegment"]


def _after():
    return F.expr(f"o_orderdate >= timestamp_ntz'{_SPLIT}'")


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _counts(spark, sf_dir):
    return compare.value_counts(sales(spark, sf_dir), "o_totalprice", _after(), _SEGMENT)


def _sides(spark, sf_dir):
    return compare.side_ranks(_counts(spark, sf_dir), _SEGMENT)


def _moments(spark, sf_dir):
    return compare.two_sample_moments(sales(spark, sf_dir), "o_totalprice", _after(), _SEGMENT)


def normality_gate(spark, sf_dir):
    gate = compare.normality_gate(_moments(spark, sf_dir))
    return _round(gate, 6, "jb_a", "jb_b", "p_normal_a", "p_normal_b").select(
        "c_mktsegment", "n_a", "n_b", "jb_a", "jb_b", "p_normal_a", "p_normal_b", "is_normal"
    )


def shapiro_francia(spark, sf_dir):
    return _round(compare.shapiro_francia(_sides(spark, sf_dir), _SEGMENT), 6, "w_a", "w_b", "p_normal_a", "p_normal_b")


def brown_forsythe(spark, sf_dir):
    return _round(compare.brown_forsythe(_sides(spark, sf_dir), _SEGMENT), 6, "levene_f", "levene_p")


def t_test(spark, sf_dir):
    variance = compare.brown_forsythe(_sides(spark, sf_dir), _SEGMENT).select("c_mktsegment", "equal_var")
    tested = compare.t_test(_moments(spark, sf_dir).join(variance, _SEGMENT))
    return _round(tested, 6, "statistic", "df", "p").select(
        "c_mktsegment", "test_name", "n_a", "n_b", "statistic", "df", "p"
    )


def cohens_d(spark, sf_dir):
    tested = compare.t_test(_moments(spark, sf_dir).withColumn("equal_var", F.lit(True)))
    return _round(tested, 6, "effect_size").select(
        "c_mktsegment",
        "effect_size",
        *[F.round(c, 2).alias(c) for c in ("diff", "ci_lower", "ci_upper")],
    )


def mann_whitney(spark, sf_dir):
    return _round(compare.mann_whitney(_counts(spark, sf_dir), _SEGMENT), 6, "z", "p", "effect_size")


def bootstrap_median_ci(spark, sf_dir):
    return _round(compare.exact_median_ci(_sides(spark, sf_dir), _SEGMENT), 0, "ci_lower", "ci_upper")


def before_after(spark, sf_dir):
    result = compare.before_after(sales(spark, sf_dir), "o_totalprice", _after(), _SEGMENT)
    return _round(_round(result, 6, "statistic", "p", "effect_size"), 0, "ci_lower", "ci_upper").select(
        "c_mktsegment", "test_name", "statistic", "p", "effect_size", "effect_kind", "ci_lower", "ci_upper", "n_a", "n_b",
        F.round("mean_a", 2).alias("mean_a"), F.round("mean_b", 2).alias("mean_b"), "status",
    )


def association(spark, sf_dir):
    result = associate.association(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return _round(result, 6, "pearson_r", "pearson_p", "pearson_ci_lower", "pearson_ci_upper").drop("status", "error")


def spearman(spark, sf_dir):
    result = associate.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return _round(result, 6, "spearman_r", "spearman_p")


def diff_association(spark, sf_dir):
    result = associate.diff_association(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"],
    )
    return _round(result, 6, "diff_pearson_r", "diff_pearson_p")


def _controlled(spark, sf_dir, controls):
    return associate.controlled_association(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", controls, ["l_returnflag"]
    )


def partial_correlation(spark, sf_dir):
    result = _controlled(spark, sf_dir, ["l_discount", "l_tax"])
    return _round(
        result, 6, "raw_effect", "controlled_effect", "attenuation_ratio", "p_value", "ci_lower", "ci_upper"
    ).select(
        "l_returnflag", "n", "raw_effect", "controlled_effect", "attenuation_ratio", "p_value", "ci_lower", "ci_upper",
        "status",
    )


def vif(spark, sf_dir):
    return _round(_controlled(spark, sf_dir, ["l_discount"]), 6, "vif_x").select("l_returnflag", "n", "vif_x")


def ols_r2(spark, sf_dir):
    return _round(_controlled(spark, sf_dir, ["l_discount"]), 6, "r_squared").select("l_returnflag", "n", "r_squared")


def _hourly(spark, sf_dir):
    return series.bucketed_series(table(spark, sf_dir, "events"), "ts", "hour", "value", ["event_type"])


def adf_test(spark, sf_dir):
    result = series.adf_test(_hourly(spark, sf_dir), ["event_type"], "t", "value", 24)
    return _round(result, 5, "tau", "critical_5", "adf_p_value").select(
        "event_type", "n", "used_lag", "tau", "critical_5", "adf_p_value", "is_stationary", "status"
    )


def loess_smooth(spark, sf_dir):
    """Hourly totals smoothed over 25 hours, once re-weighted against outliers."""
    result = series.loess_smooth(_hourly(spark, sf_dir), ["event_type"], "t", "value", 25)
    return _round(result, 4, "value", "smooth", "resid")


def robust_strength(spark, sf_dir):
    return _round(series.robust_strength(_hourly(spark, sf_dir), ["event_type"], "t", "value", 24), 6, "seasonal_strength")


def seasonal_strength(spark, sf_dir):
    return _round(
        series.seasonal_strength(_hourly(spark, sf_dir), ["event_type"], "t", "value", 24), 6, "seasonal_strength"
    )


def power_analysis(spark, sf_dir):
    tested = compare.t_test(_moments(spark, sf_dir).withColumn("equal_var", F.lit(True)))
    result = compare.power_analysis(tested.select("c_mktsegment", "effect_size", "n_a", "n_b"))
    return _round(result, 4, "power").select("c_mktsegment", "n_a", "n_b", "power", "reaches_target")


def _cell_tests(spark, sf_dir):
    """One t test per segment and nation; a segment is a family."""
    groups = ["c_mktsegment", "c_nationkey"]
    moments = compare.two_sample_moments(sales(spark, sf_dir), "o_totalprice", _after(), groups)
    tested = compare.t_test(moments.where("n_a >= 3 and n_b >= 3").withColumn("equal_var", F.lit(True)))
    return tested.select(*groups, "p")


def bh_fdr(spark, sf_dir):
    return _round(discovery.bh_fdr(_cell_tests(spark, sf_dir), _SEGMENT), 6, "p", "q")


def experiment(spark, sf_dir):
    """Customer spend after minus before the split; odd nations are treated."""
    late = _after()
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            (
                F.coalesce(F.sum(F.when(late, money(F.col("o_totalprice")))), F.lit(0))
                - F.coalesce(F.sum(F.when(~late, money(F.col("o_totalprice")))), F.lit(0))
            ).cast("double").alias("outcome")
        )
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(spend, customers.c_custkey == spend.o_custkey, "left").select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_nationkey") % 2).alias("is_treated"),
        F.coalesce("outcome", F.lit(0.0)).alias("outcome"),
        "c_acctbal",
        (F.col("c_custkey") * 7919 % 100).alias("lucky_number"),
        (F.col("c_custkey") * 31 % 24).alias("signup_hour"),
    )


_TREATED = "is_treated = 1"


def naive_ate(spark, sf_dir):
    data = experiment(spark, sf_dir).withColumn("sample", F.lit("all"))
    result = causal.naive_ate(data, "outcome", F.expr(_TREATED), ["sample"])
    return _round(_round(result, 2, "estimate"), 6, "statistic", "p_value")


_NOISE = ["lucky_number", "signup_hour", "c_acctbal"]


def noise_scan(spark, sf_dir):
    return _round(causal.noise_scan(experiment(spark, sf_dir), _NOISE, "outcome"), 6, "r", "p", "q")


def stratified_ate(spark, sf_dir):
    result = causal.stratified_ate(experiment(spark, sf_dir), "outcome", F.expr(_TREATED), ["segment"])
    return _round(result, 2, "att", "att_se", "ate", "ate_se")


def estimator_scoreboard(spark, sf_dir):
    """Nation parity is a placebo treatment, so the true effect is 0."""
    result = causal.scoreboard(experiment(spark, sf_dir), "outcome", F.expr(_TREATED), ["segment"], _NOISE, 0.0)
    return _round(result, 2, "estimate", "absolute_error")


_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
HYPOTHESES = [
    Hypothesis("H1", "association", "l_quantity", "l_extendedprice", options={"order": _LINE_ORDER}),
    Hypothesis("H2", "association", "l_discount", "l_tax"),
    Hypothesis("H3", "before_after", "l_discount", "l_tax"),
    Hypothesis("H4", "controlled_association", "l_quantity", "l_extendedprice", ("l_discount",)),
    Hypothesis("H5", "timeseries", "l_quantity", options={"time": "l_shipdate", "unit": "day", "period": 7, "robust": False}),
    Hypothesis("H6", "chi_square", "l_quantity", "l_tax"),
    Hypothesis("H7", "association", "l_quantity", "l_weight"),
]


def run_hypotheses(spark, sf_dir):
    results = default_registry().run(table(spark, sf_dir, "lineitem"), HYPOTHESES)
    return results.select(
        "hypothesis_id", "test_name", "status", "error", F.explode_outer("result").alias("key", "value")
    ).select("hypothesis_id", "test_name", "status", "error", "key", F.round("value", 5).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        normality_gate, shapiro_francia, brown_forsythe, t_test, cohens_d, mann_whitney, bootstrap_median_ci, before_after, association,
        spearman, diff_association, partial_correlation, vif, ols_r2, adf_test, seasonal_strength, loess_smooth, robust_strength,
        power_analysis, bh_fdr,
        naive_ate, noise_scan, stratified_ate, estimator_scoreboard, run_hypotheses,
    )
}


def t_p_sql(t: str, df: str) -> str:
    """Two-sided t p-value: 1 - 2c * integral of cos(u)^(df-1) from 0 to atan(|t|/sqrt(df))."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    weight = "CASE WHEN k IN (0, 800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"""greatest(0.0, 1.0 - 2.0 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) *
      (SELECT SUM({weight} * pow(cos(k * {theta} / 800.0), {df} - 1.0)) FROM generate_series(0, 800) AS g(k)) * {theta} / 2400.0)"""


def z_p_sql(z: str) -> str:
    """Two-sided normal p-value by Simpson integration of the density."""
    weight = "CASE WHEN k IN (0, 800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"""greatest(0.0, 1.0 - 2.0 / sqrt(2.0 * pi()) *
      (SELECT SUM({weight} * exp(-0.5 * pow(k * abs({z}) / 800.0, 2))) FROM generate_series(0, 800) AS g(k)) * abs({z}) / 2400.0)"""


_S = f"WITH s AS ({SALES_SQL}), o AS (SELECT *, o_orderdate >= TIMESTAMP '{_SPLIT}' AS is_b FROM s)"


def _moments_sql(groups: str, source: str = "o", value: str = "o_totalprice") -> str:
    sides = ", ".join(
        f"""COUNT({value}) FILTER (WHERE {m}) AS n_{k}, AVG({value}) FILTER (WHERE {m}) AS mean_{k},
        var_samp({value}) FILTER (WHERE {m}) AS var_{k}, skewness({value}) FILTER (WHERE {m}) AS raw_skew_{k},
        kurtosis_pop({value}) FILTER (WHERE {m}) AS kurt_{k}"""
        for k, m in (("a", "NOT is_b"), ("b", "is_b"))
    )
    return f"SELECT {groups}, {sides} FROM {source} GROUP BY {groups}"


_M = _S + f", m AS ({_moments_sql('c_mktsegment')})"

_GATE = ", ".join(
    f"""raw_skew_{k} * (n_{k} - 2) / sqrt(n_{k}::DOUBLE * (n_{k} - 1)) AS skew_{k}""" for k in "ab"
)
_JB = f""", sk AS (SELECT *, {_GATE} FROM m),
j AS (SELECT *, n_a / 6.0 * (skew_a * skew_a + kurt_a * kurt_a / 4.0) AS jb_a,
  n_b / 6.0 * (skew_b * skew_b + kurt_b * kurt_b / 4.0) AS jb_b FROM sk),
gate AS (SELECT c_mktsegment, n_a, n_b, jb_a, jb_b, exp(-jb_a / 2) AS p_normal_a, exp(-jb_b / 2) AS p_normal_b,
  NOT (exp(-jb_a / 2) < 0.05 OR exp(-jb_b / 2) < 0.05) AS is_normal FROM j)"""

def _polynomial_sql(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text}) * {x} + {c!r}"
    return text


def _fraction_sql(part: tuple, x: str) -> str:
    return f"({_polynomial_sql(part[0], x)}) / ({_polynomial_sql(part[1], x)})"


def shapiro_sql(source: str, group: str, value: str) -> str:
    """CTEs ending in ``sf``: W', its p and the verdict per group, from ranks of every row."""
    middle, tail, far = dist.NORMAL_QUANTILE
    upper = f"CASE WHEN z >= 0 THEN ({z_p_sql('z')}) / 2.0 ELSE 1.0 - ({z_p_sql('z')}) / 2.0 END"
    return f""", sfr AS (SELECT {group} AS g, is_b, {value} AS v, COUNT(*) OVER w AS n, AVG({value}) OVER w AS mu,
  rank() OVER (PARTITION BY {group}, is_b ORDER BY {value}) + (COUNT(*) OVER (PARTITION BY {group}, is_b, {value}) - 1) / 2.0 AS r
  FROM {source} WINDOW w AS (PARTITION BY {group}, is_b)),
sfp AS (SELECT *, (r - 0.375) / (n + 0.25) AS p FROM sfr),
sfq AS (SELECT *, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS x1, sqrt(-ln(least(p, 1 - p))) - 1.6 AS x2, sqrt(-ln(least(p, 1 - p))) - 5.0 AS x3 FROM sfp),
sfm AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_fraction_sql(middle, 'x1')}
  WHEN x3 <= 0 THEN sign(q) * {_fraction_sql(tail, 'x2')} ELSE sign(q) * {_fraction_sql(far, 'x3')} END AS m FROM sfq),
sfs AS (SELECT g, is_b, MAX(n)::DOUBLE AS n, SUM((v - mu) * (v - mu)) AS dd, SUM((v - mu) * m) AS dm, SUM(m) AS sm, SUM(m * m) AS mm FROM sfm GROUP BY 1, 2),
sfw AS (SELECT *, dm * dm / (dd * (mm - sm * sm / n)) AS w, ln(ln(n)) AS lv, ln(n) AS lu FROM sfs),
sfz AS (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (lv - lu))) / (1.0308 - 0.26758 * (lv + 2 / lu)) AS z FROM sfw),
sft AS (SELECT *, {upper} AS p FROM sfz),
sf AS (SELECT g, MAX(w) FILTER (WHERE NOT is_b) AS w_a, MAX(w) FILTER (WHERE is_b) AS w_b, MAX(p) FILTER (WHERE NOT is_b) AS p_a,
  MAX(p) FILTER (WHERE is_b) AS p_b, MIN(p) >= 0.05 AS is_normal FROM sft GROUP BY 1)"""


def median_ci_sql(source: str, group: str, value: str, terms: int) -> str:
    """CTEs ending in ``bci``: quantiles of the difference of two resampled medians, from binomial sums of ``terms`` terms."""

    def tail(x: str) -> str:
        term = f"exp(lgamma(n + 1) - lgamma(k + s + 1) - lgamma(n - k - s + 1) + (k + s) * ln({x}) + (n - k - s) * ln(1 - {x}))"
        return f"""CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} * n - k > 8 * sqrt(n) THEN 1.0 WHEN k - {x} * n > 8 * sqrt(n) THEN 0.0
      ELSE (SELECT SUM(CASE WHEN k + s <= n THEN {term} ELSE 0 END) FROM generate_series(0, {terms}) AS x(s)) END"""

    return f""", bv AS (SELECT {group} AS g, is_b, {value} AS v, COUNT(*) AS c FROM {source} GROUP BY ALL),
bc AS (SELECT g, is_b, v, c::DOUBLE AS c, SUM(c) OVER (PARTITION BY g, is_b ORDER BY v)::DOUBLE AS hi, SUM(c) OVER (PARTITION BY g, is_b)::DOUBLE AS n FROM bv),
bf AS (SELECT g, is_b, v, n, floor((n + 1) / 2) AS k, hi / n AS f, (hi - c) / n AS f0, n % 2 = 1 AS odd,
  lgamma(n + 1) - 2 * lgamma(floor((n + 1) / 2) + 1) AS choose FROM bc WHERE hi >= n / 2 - 7 * sqrt(n) - 1 AND hi - c <= n / 2 + 7 * sqrt(n) + 1),
bt AS (SELECT *, {tail('f')} AS tf, {tail('f0')} AS tf0 FROM bf),
b1 AS (SELECT g, is_b, v, tf - tf0 - CASE WHEN odd OR f >= 1 THEN 0 ELSE exp(choose + k * ln(f) + k * ln(1 - f)) * (1 - pow(f0 / f, k)) END AS p FROM bt
  UNION ALL SELECT a.g, a.is_b, (a.v + b.v) / 2, exp(a.choose + a.k * ln(a.f) + a.k * ln(1 - b.f0)) * (1 - pow(a.f0 / a.f, a.k)) * (1 - pow((1 - b.f) / (1 - b.f0), a.k))
  FROM bt a JOIN bt b ON a.g = b.g AND a.is_b = b.is_b AND a.v < b.v WHERE NOT a.odd),
bp AS (SELECT g, is_b, round(v * 1000)::BIGINT AS v, SUM(p) AS p FROM b1 GROUP BY ALL HAVING SUM(p) > 1e-12),
bd AS (SELECT a.g, b.v - a.v AS d, SUM(a.p * b.p) AS p FROM bp a JOIN bp b ON a.g = b.g AND NOT a.is_b AND b.is_b GROUP BY ALL),
bs AS (SELECT g, d, SUM(p) OVER (PARTITION BY g ORDER BY d) AS cum FROM bd),
bci AS (SELECT g, MIN(d) FILTER (WHERE cum >= 0.025) / 1000.0 AS ci_lower, MIN(d) FILTER (WHERE cum >= 0.975) / 1000.0 AS ci_upper FROM bs GROUP BY 1)"""


_SHAPIRO, _MEDIANS = shapiro_sql("o", "c_mktsegment", "o_totalprice"), median_ci_sql("o", "c_mktsegment", "o_totalprice", 800)

_LEVENE = f""", med AS (SELECT c_mktsegment, is_b, median(o_totalprice) AS md FROM o GROUP BY ALL),
dev AS (SELECT o.c_mktsegment, o.is_b, abs(o_totalprice - md) AS z FROM o JOIN med ON o.c_mktsegment = med.c_mktsegment AND o.is_b = med.is_b),
grand AS (SELECT c_mktsegment, AVG(z) AS gm, COUNT(*) AS n FROM dev GROUP BY 1),
arm AS (SELECT c_mktsegment, is_b, AVG(z) AS am, COUNT(*) AS an, var_pop(z) * COUNT(*) AS ss FROM dev GROUP BY 1, 2),
lev0 AS (SELECT arm.c_mktsegment, MAX(CASE WHEN NOT is_b THEN an END) AS n_a, MAX(CASE WHEN is_b THEN an END) AS n_b,
  SUM(an * (am - gm) * (am - gm)) * (MAX(n) - 2) / SUM(ss) AS levene_f
  FROM arm JOIN grand ON arm.c_mktsegment = grand.c_mktsegment GROUP BY 1),
lev AS (SELECT *, {t_p_sql('sqrt(levene_f)', '(n_a + n_b - 2)::DOUBLE')} AS levene_p FROM lev0)"""

_TT = """, tt0 AS (SELECT m.*, levene_p >= 0.05 AS equal_var,
  ((m.n_a - 1) * var_a + (m.n_b - 1) * var_b) / (m.n_a + m.n_b - 2) AS pooled, var_a / m.n_a AS sa, var_b / m.n_b AS sb
  FROM m JOIN lev ON m.c_mktsegment = lev.c_mktsegment),
tt1 AS (SELECT *, CASE WHEN equal_var THEN sqrt(pooled * (1.0 / n_a + 1.0 / n_b)) ELSE sqrt(sa + sb) END AS se,
  CASE WHEN equal_var THEN (n_a + n_b - 2)::DOUBLE ELSE (sa + sb) * (sa + sb) / (sa * sa / (n_a - 1) + sb * sb / (n_b - 1)) END AS df,
  CASE WHEN equal_var THEN 'Student''s t-test' ELSE 'Welch''s t-test' END AS test_name FROM tt0),
tt2 AS (SELECT *, (mean_b - mean_a) / se AS statistic, (mean_b - mean_a) / sqrt(pooled) AS effect_size FROM tt1)"""
_TTP = _TT + f", tt AS (SELECT *, {t_p_sql('statistic', 'df')} AS p FROM tt2)"

_MWU = f""", rk AS (SELECT c_mktsegment, is_b,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) + (COUNT(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2.0 AS r,
  COUNT(*) OVER (PARTITION BY c_mktsegment, o_totalprice) AS t FROM o),
mw0 AS (SELECT c_mktsegment, COUNT(*) FILTER (WHERE NOT is_b) AS n_a, COUNT(*) FILTER (WHERE is_b) AS n_b,
  SUM(r) FILTER (WHERE is_b) AS rank_sum, SUM(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY 1),
mw1 AS (SELECT *, rank_sum - n_b * (n_b + 1) / 2.0 AS statistic, n_a::DOUBLE * n_b AS pairs, (n_a + n_b)::DOUBLE AS n FROM mw0),
mw2 AS (SELECT *, greatest(0.0, (abs(statistic - pairs / 2.0) - 0.5) / sqrt(pairs / 12.0 * ((n + 1) - ties / (n * (n - 1))))) AS z,
  2.0 * statistic / pairs - 1.0 AS effect_size FROM mw1),
mw AS (SELECT *, {z_p_sql('z')} AS p FROM mw2)"""

_Z = "1.959963984540054"

_L = "lineitem"
_CORR_X = "corr(l_quantity, l_extendedprice)"


def _corr_p(r: str, n: str) -> str:
    return t_p_sql(f"({r} * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2)::DOUBLE")


_SPEARMAN = f"""WITH rk AS (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry
  FROM lineitem),
c AS (SELECT l_returnflag, COUNT(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY 1)
SELECT l_returnflag, n, ROUND(r, 6) AS spearman_r, ROUND({_corr_p('r', 'n')}, 6) AS spearman_p FROM c"""

_DIFF = f"""WITH d AS (SELECT l_returnflag, l_quantity - lag(l_quantity) OVER w AS dx, l_extendedprice - lag(l_extendedprice) OVER w AS dy
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)),
c AS (SELECT l_returnflag, COUNT(dx) AS n, corr(dx, dy) AS r FROM d WHERE dx IS NOT NULL GROUP BY 1)
SELECT l_returnflag, n AS diff_n, ROUND(r, 6) AS diff_pearson_r, ROUND({_corr_p('r', 'n')}, 6) AS diff_pearson_p FROM c"""

_PARTIAL2 = f"""WITH c AS (SELECT l_returnflag, COUNT(*) AS n, corr(l_quantity, l_extendedprice) AS xy,
  corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz, corr(l_quantity, l_tax) AS xw,
  corr(l_extendedprice, l_tax) AS yw, corr(l_discount, l_tax) AS zw FROM lineitem GROUP BY 1),
a AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS xy_z,
  (xw - xz * zw) / sqrt((1 - xz * xz) * (1 - zw * zw)) AS xw_z, (yw - yz * zw) / sqrt((1 - yz * yz) * (1 - zw * zw)) AS yw_z FROM c),
p AS (SELECT *, (xy_z - xw_z * yw_z) / sqrt((1 - xw_z * xw_z) * (1 - yw_z * yw_z)) AS r FROM a)
SELECT l_returnflag, n, ROUND(xy, 6) AS raw_effect, ROUND(r, 6) AS controlled_effect,
  ROUND(abs(r) / abs(xy), 6) AS attenuation_ratio,
  ROUND({_corr_p('r', '(n - 2)')}, 6) AS p_value,
  ROUND(tanh(atanh(r) - {_Z} / sqrt(n - 5)), 6) AS ci_lower, ROUND(tanh(atanh(r) + {_Z} / sqrt(n - 5)), 6) AS ci_upper,
  'ok' AS status FROM p"""

_HOURLY = """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, SUM(CAST(value AS DECIMAL(18,2)))::DOUBLE AS v
  FROM events GROUP BY 1, 2),
span AS (SELECT event_type, MIN(t) AS lo, MAX(t) AS hi FROM h GROUP BY 1),
cal AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM span),
pts AS (SELECT cal.event_type, cal.t, COALESCE(h.v, 0.0) AS v FROM cal LEFT JOIN h ON h.event_type = cal.event_type AND h.t = cal.t)"""


def _polynomial(*coefficients: float) -> str:
    return " + ".join(f"({c}) * pow(tau, {i})" for i, c in enumerate(coefficients))


def _lag_stage(name: str, lags: str, source: str) -> str:
    """Cross moments of (1, differences back, level, difference) for a number of lags, swept column by column."""
    width = "(s + 3)"
    return f"""{name}c AS (SELECT event_type, n, s, j, CASE WHEN j = 0 THEN list_transform(range(s + 1, n), lambda i: 1.0::DOUBLE)
    WHEN j <= s THEN dy[s + 1 - j : n - 1 - j] WHEN j = s + 1 THEN y[s + 1 : n - 1] ELSE dy[s + 1 : n - 1] END AS col
  FROM (SELECT *, {lags} AS s, unnest(range(0, {lags} + 3)) AS j FROM {source})),
{name}g AS (SELECT a.event_type, a.n, a.s, list(list_dot_product(a.col, b.col) ORDER BY a.j, b.j) AS g FROM {name}c a JOIN {name}c b ON a.event_type = b.event_type GROUP BY ALL),
{name} AS (SELECT event_type, n, s, 0::BIGINT AS step, g FROM {name}g UNION ALL
  SELECT event_type, n, s, step + 1, list_transform(range(0, {width} * {width}),
    lambda x: g[x + 1] - g[(x // {width}) * {width} + step + 1] * g[step * {width} + x % {width} + 1] / g[step * {width} + step + 1])
  FROM {name} WHERE step <= s),
{name}m AS (SELECT event_type, n, s, step, n - 1 - s AS m, g[{width} * (s + 1) + s + 2] AS ll, g[{width} * (s + 1) + s + 3] AS lt, g[{width} * (s + 2) + s + 3] AS tt
  FROM {name} WHERE step > 0)"""


_ADF_CTES = (
    f""", a0 AS (SELECT event_type, list(v - mu ORDER BY t) AS y, COUNT(*) AS n FROM
  (SELECT *, AVG(v) OVER (PARTITION BY event_type) AS mu FROM pts) GROUP BY 1),
a1 AS (SELECT *, CAST(least(n // 2 - 2, ceil(12.0 * pow(n / 100.0, 0.25))) AS BIGINT) AS most, list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS dy FROM a0),
{_lag_stage('la', 'most', 'a1')},
best AS (SELECT event_type, arg_min(step - 1, m * ln((tt - lt * lt / ll) / m) + 2 * (step + 1)) AS chosen FROM lam GROUP BY 1),
a2 AS (SELECT a1.*, chosen FROM a1 JOIN best ON a1.event_type = best.event_type),
{_lag_stage('lb', 'chosen', 'a2')},
u AS (SELECT event_type, n, m, s AS used_lag, lt / ll / sqrt((tt - lt * lt / ll) / (m - s - 2) / ll) AS tau FROM lbm WHERE step = s + 1),
z AS (SELECT *, CASE WHEN tau <= -1.61 THEN {_polynomial(2.1659, 1.4412, 0.038269)}
  ELSE {_polynomial(1.7339, 0.93202, -0.12745, -0.010368)} END AS zz FROM u),
pv AS (SELECT *, {z_p_sql('zz')} / 2.0 AS tail FROM z),
q AS (SELECT *, CASE WHEN tau < -18.83 THEN 0.0 WHEN tau > 2.74 THEN 1.0 WHEN zz < 0 THEN tail ELSE 1 - tail END AS p FROM pv)"""
)
_ADF = (
    _HOURLY.replace("WITH", "WITH RECURSIVE", 1)
    + _ADF_CTES
    + """ SELECT event_type, n, CAST(used_lag AS INTEGER) AS used_lag, ROUND(tau, 5) AS tau,
  ROUND(-2.86154 - 2.8903 / m - 4.234 / pow(m, 2) - 40.04 / pow(m, 3), 5) AS critical_5,
  ROUND(p, 5) AS adf_p_value, p < 0.05 AS is_stationary, 'ok' AS status FROM q"""
)


def _loess_sql(name: str, source: str, window: int, weighted: bool) -> str:
    """One LOESS pass over ``source`` (event_type, t, i, n, v and, when weighted, rw), as CTE ``name`` with ``smooth``."""
    weight = "CASE WHEN r <= 0.001 * h THEN 1.0 WHEN r <= 0.999 * h THEN pow(1 - pow(r / h, 3), 3) ELSE 0.0 END" + (" * rw" if weighted else "")
    extra = ", b.rw" if weighted else ""
    return f"""{name}p AS (SELECT a.event_type, a.t, a.i, a.n, a.v AS own, b.v, b.i - a.i AS o, abs(b.i - a.i)::DOUBLE AS r, greatest(a.i - a.lo, a.lo + {window - 1} - a.i)::DOUBLE AS h{extra}
  FROM (SELECT *, greatest(0, least(i - {(window + 1) // 2 - 1}, n - {window})) AS lo FROM {source}) a
  JOIN {source} b ON a.event_type = b.event_type AND b.i BETWEEN a.lo AND a.lo + {window - 1}),
{name}w AS (SELECT *, {weight} AS w FROM {name}p),
{name}s AS (SELECT event_type, i, SUM(w) AS sw, SUM(w * o) / SUM(w) AS mid FROM {name}w GROUP BY 1, 2),
{name}q AS (SELECT w.*, sw, mid, SUM(w * (o - mid) * (o - mid)) OVER (PARTITION BY w.event_type, w.i) / sw AS spread
  FROM {name}w w JOIN {name}s s ON w.event_type = s.event_type AND w.i = s.i),
{name} AS (SELECT event_type, t, i, n, MAX(own) AS v, CASE WHEN MAX(sw) > 0 THEN
    SUM(w / sw * v * CASE WHEN sqrt(spread) > 0.001 * (n - 1) THEN 1 - mid / spread * (o - mid) ELSE 1 END) ELSE MAX(own) END AS smooth
  FROM {name}q GROUP BY 1, 2, 3, 4)"""


_LOESS = (
    _HOURLY
    + f""", num AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM pts),
{_loess_sql('one', 'num', 25, False)},
md AS (SELECT *, 6 * median(abs(v - smooth)) OVER (PARTITION BY event_type) AS c FROM one),
rw AS (SELECT event_type, t, i, n, v, CASE WHEN c = 0 OR abs(v - smooth) <= 0.001 * c THEN 1.0 WHEN abs(v - smooth) <= 0.999 * c
  THEN pow(1 - pow((v - smooth) / c, 2), 2) ELSE 0.0 END AS rw FROM md),
{_loess_sql('two', 'rw', 25, True)}
SELECT event_type, t, ROUND(v, 4) AS value, ROUND(smooth, 4) AS smooth, ROUND(v - smooth, 4) AS resid FROM two"""
)

_SEASONAL = (
    _HOURLY
    + """, i AS (SELECT *, row_number() OVER w - 1 AS i,
  SUM(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS wide,
  SUM(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) AS inside,
  COUNT(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS c
  FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY t)),
d AS (SELECT event_type, i % 24 AS phase, CASE WHEN c = 25 THEN v - (wide + inside) / 48.0 END AS d FROM i),
ph AS (SELECT event_type, phase, AVG(d) AS raw FROM d GROUP BY 1, 2),
ce AS (SELECT event_type, AVG(raw) AS centre FROM ph GROUP BY 1),
se AS (SELECT ph.event_type, phase, raw - centre AS s FROM ph JOIN ce ON ph.event_type = ce.event_type)
SELECT d.event_type, COUNT(*) AS n, ROUND(greatest(0.0, 1 - var_pop(d - s) / var_pop(d)), 6) AS seasonal_strength, 'ok' AS status
FROM d JOIN se ON d.event_type = se.event_type AND d.phase = se.phase GROUP BY 1"""
)



def t_quantile_sql(df: str) -> str:
    """Upper 2.5 % point of t by the Cornish-Fisher expansion (df in the thousands)."""
    z = 1.959963984540054
    return (
        f"({z} + {(z**3 + z) / 4} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / pow({df}, 2)"
        f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / pow({df}, 3))"
    )


_PHI = f"CASE WHEN arg >= 0 THEN 1 - ({z_p_sql('arg')}) / 2 ELSE ({z_p_sql('arg')}) / 2 END"
_SIMPSON_400 = "CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"

# The pooled t test per segment, then the rejection probability averaged over
# the density of s = sqrt(chi2 / df) on a Simpson grid.
_POWER = """, pt AS (SELECT c_mktsegment, n_a, n_b, (n_a + n_b - 2)::DOUBLE AS df,
  abs(mean_b - mean_a) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) * sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) AS shift FROM m),
pc AS (SELECT *, {t} AS crit, 1 - 8 / sqrt(2 * df) AS lo, 16 / sqrt(2 * df) AS span FROM pt),
pg AS (SELECT c_mktsegment, n_a, n_b, df, shift, crit, span, k, lo + span * k / 400.0 AS s FROM pc, generate_series(0, 400) AS g(k)),
pa AS (SELECT *, unnest([shift - crit * s, -shift - crit * s]) AS arg FROM pg),
pp AS (SELECT c_mktsegment, n_a, n_b, SUM({w} * exp(ln(2) + df / 2 * ln(df / 2) - lgamma(df / 2) + (df - 1) * ln(s) - df * s * s / 2)
  * ({phi})) * MAX(span) / 1200.0 AS power FROM pa GROUP BY 1, 2, 3)
SELECT c_mktsegment, n_a, n_b, ROUND(power, 4) AS power, power >= 0.8 AS reaches_target FROM pp""".format(
    t=t_quantile_sql("df"), w=_SIMPSON_400, phi=_PHI
)

EXPERIMENT_SQL = f"""SELECT c_custkey, c_mktsegment AS segment, c_nationkey % 2 AS is_treated,
  COALESCE(outcome, 0.0) AS outcome, c_acctbal, c_custkey * 7919 % 100 AS lucky_number, c_custkey * 31 % 24 AS signup_hour
FROM customer LEFT JOIN (SELECT o_custkey,
  CAST(COALESCE(SUM(CASE WHEN o_orderdate >= TIMESTAMP '{_SPLIT}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0)
  - COALESCE(SUM(CASE WHEN o_orderdate < TIMESTAMP '{_SPLIT}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS outcome
  FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
_X = f"WITH x AS ({EXPERIMENT_SQL}), o AS (SELECT *, is_treated = 1 AS is_b FROM x)"

_POOLED = """((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)"""

NAIVE_SQL = f"""m AS (SELECT COUNT(*) FILTER (WHERE is_b) AS n_b, COUNT(*) FILTER (WHERE NOT is_b) AS n_a,
  AVG(outcome) FILTER (WHERE is_b) AS mean_b, AVG(outcome) FILTER (WHERE NOT is_b) AS mean_a,
  var_samp(outcome) FILTER (WHERE is_b) AS var_b, var_samp(outcome) FILTER (WHERE NOT is_b) AS var_a FROM o),
naive AS (SELECT *, mean_b - mean_a AS estimate,
  (mean_b - mean_a) / sqrt({_POOLED} * (1.0 / n_a + 1.0 / n_b)) AS statistic FROM m)"""

_NOISE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS candidate, COUNT(*) AS n, corr({c}, outcome) AS r FROM o" for c in _NOISE
)
NOISE_CTES = f"""nz AS ({_NOISE_SQL}), np AS (SELECT *, {_corr_p('r', 'n')} AS p FROM nz),
nr AS (SELECT *, p * COUNT(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM np),
noise AS (SELECT *, least(1.0, MIN(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM nr)"""

STRATA_CTES = """st AS (SELECT segment, COUNT(*) FILTER (WHERE is_b) AS n_b, COUNT(*) FILTER (WHERE NOT is_b) AS n_a,
  AVG(outcome) FILTER (WHERE is_b) - AVG(outcome) FILTER (WHERE NOT is_b) AS diff,
  var_samp(outcome) FILTER (WHERE is_b) / COUNT(*) FILTER (WHERE is_b)
  + var_samp(outcome) FILTER (WHERE NOT is_b) / COUNT(*) FILTER (WHERE NOT is_b) AS v FROM o GROUP BY 1),
strata AS (SELECT COUNT(*) AS strata, SUM(n_b)::BIGINT AS n_treated, SUM(n_a)::BIGINT AS n_control,
  SUM(n_b * diff) / SUM(n_b) AS att, sqrt(SUM(n_b::DOUBLE * n_b * v) / pow(SUM(n_b), 2)) AS att_se,
  SUM((n_a + n_b) * diff) / SUM(n_a + n_b) AS ate, sqrt(SUM(pow(n_a + n_b, 2) * v) / pow(SUM(n_a + n_b), 2)) AS ate_se
  FROM st WHERE n_a > 0 AND n_b > 0)"""



def _unpivoted(hypothesis: str, test: str, keys: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{hypothesis}' AS hypothesis_id, '{test}' AS test_name, 'ok' AS status, CAST(NULL AS VARCHAR) AS error,
        '{k}' AS key, ROUND(({e})::DOUBLE, 5) AS value FROM {source}"""
        for k, e in keys.items()
    )


def _association_keys(name: str) -> dict[str, str]:
    return {
        "n": "n", "pearson_r": "r", "pearson_p": _corr_p("r", "n"),
        "pearson_ci_lower": f"tanh(atanh(r) - {_Z} / sqrt(n - 3))", "pearson_ci_upper": f"tanh(atanh(r) + {_Z} / sqrt(n - 3))",
        "spearman_r": "sr", "spearman_p": _corr_p("sr", "n"),
    }


def _association_cte(name: str, x: str, y: str) -> str:
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""{name} AS (SELECT COUNT(*) AS n, corr(x, y) AS r, corr(rx, ry) AS sr FROM (
      SELECT {x} AS x, {y} AS y, {rank(x)} AS rx, {rank(y)} AS ry FROM lineitem))"""


_HYPOTHESES = f"""WITH RECURSIVE pts AS (
  SELECT 'H5' AS event_type, c.t, COALESCE(d.v, 0.0) AS v FROM
    (SELECT unnest(generate_series(MIN(date_trunc('day', l_shipdate)), MAX(date_trunc('day', l_shipdate)), INTERVAL 1 DAY)) AS t FROM lineitem) c
    LEFT JOIN (SELECT date_trunc('day', l_shipdate) AS t, SUM(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS v FROM lineitem GROUP BY 1) d ON c.t = d.t)
{_ADF_CTES},
wi AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, AVG(v) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS tr,
  COUNT(v) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c FROM pts),
wd AS (SELECT i % 7 AS phase, CASE WHEN c = 7 THEN v - tr END AS d FROM wi),
wp AS (SELECT phase, AVG(d) AS raw FROM wd GROUP BY 1),
ws AS (SELECT phase, raw - (SELECT AVG(raw) FROM wp) AS s FROM wp),
sea AS (SELECT greatest(0.0, 1 - var_pop(d - s) / var_pop(d)) AS strength FROM wd JOIN ws ON wd.phase = ws.phase),
h5 AS (SELECT q.*, strength FROM q, sea),
{_association_cte('h1', 'l_quantity', 'l_extendedprice')}, {_association_cte('h2', 'l_discount', 'l_tax')},
ba AS (SELECT l_discount AS v, false AS is_b FROM lineitem UNION ALL SELECT l_tax, true FROM lineitem),
bo AS (SELECT 'H3' AS g, * FROM ba){median_ci_sql('bo', 'g', 'v', 3300)},
rk AS (SELECT is_b, rank() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, COUNT(*) OVER (PARTITION BY v) AS t FROM ba),
mw0 AS (SELECT COUNT(*) FILTER (WHERE NOT is_b) AS n_a, COUNT(*) FILTER (WHERE is_b) AS n_b, SUM(r) FILTER (WHERE is_b) AS rank_sum,
  SUM(t::DOUBLE * t - 1) AS ties FROM rk),
mw1 AS (SELECT *, rank_sum - n_b * (n_b + 1) / 2.0 AS statistic, n_a::DOUBLE * n_b AS pairs, (n_a + n_b)::DOUBLE AS n FROM mw0),
mw2 AS (SELECT *, greatest(0.0, (abs(statistic - pairs / 2.0) - 0.5) / sqrt(pairs / 12.0 * ((n + 1) - ties / (n * (n - 1))))) AS z FROM mw1),
h3 AS (SELECT mw2.*, bci.ci_lower, bci.ci_upper, (SELECT AVG(v) FROM ba WHERE NOT is_b) AS mean_a, (SELECT AVG(v) FROM ba WHERE is_b) AS mean_b FROM mw2, bci),
ds AS (SELECT l_quantity - lag(l_quantity) OVER w AS dx, l_extendedprice - lag(l_extendedprice) OVER w AS dy FROM lineitem WINDOW w AS (ORDER BY {', '.join(_LINE_ORDER)})),
h1d AS (SELECT COUNT(dx) AS n, corr(dx, dy) AS r FROM ds),
cc AS (SELECT COUNT(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem),
h4 AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM cc)
{_unpivoted('H1', 'association', _association_keys('h1'), 'h1')} UNION ALL {_unpivoted('H2', 'association', _association_keys('h2'), 'h2')}
UNION ALL {_unpivoted('H1', 'association', {"diff_pearson_r": "r", "diff_pearson_p": _corr_p("r", "n")}, 'h1d')}
UNION ALL {_unpivoted('H3', 'before_after', {
    "statistic": "statistic", "p": z_p_sql("z"), "effect_size": "2.0 * statistic / pairs - 1.0", "ci_lower": "ci_lower",
    "ci_upper": "ci_upper", "n_a": "n_a", "n_b": "n_b", "mean_a": "mean_a", "mean_b": "mean_b"}, 'h3')}
UNION ALL {_unpivoted('H4', 'controlled_association', {
    "n": "n", "raw_effect": "xy", "controlled_effect": "r", "attenuation_ratio": "abs(r) / abs(xy)", "p_value": _corr_p("r", "(n - 1)"),
    "ci_lower": f"tanh(atanh(r) - {_Z} / sqrt(n - 4))", "ci_upper": f"tanh(atanh(r) + {_Z} / sqrt(n - 4))",
    "vif_x": "1 / (1 - xz * xz)", "r_squared": "(xy * xy + yz * yz - 2 * xy * yz * xz) / (1 - xz * xz)"}, 'h4')}
UNION ALL {_unpivoted('H5', 'timeseries', {
    "n": "n", "tau": "tau", "used_lag": "used_lag", "adf_p_value": "p", "is_stationary": "CASE WHEN p < 0.05 THEN 1 ELSE 0 END", "seasonal_strength": "strength"}, 'h5')}
UNION ALL SELECT 'H6', 'chi_square', 'error', 'no test named chi_square', NULL, NULL
UNION ALL SELECT 'H7', 'association', 'error', 'absent columns: l_weight', NULL, NULL"""

ORACLE = {
    "normality_gate": _M + _JB + """ SELECT c_mktsegment, n_a, n_b, ROUND(jb_a, 6) AS jb_a, ROUND(jb_b, 6) AS jb_b,
      ROUND(p_normal_a, 6) AS p_normal_a, ROUND(p_normal_b, 6) AS p_normal_b, is_normal FROM gate""",
    "shapiro_francia": _S + _SHAPIRO + """ SELECT g AS c_mktsegment, ROUND(w_a, 6) AS w_a, ROUND(w_b, 6) AS w_b,
      ROUND(p_a, 6) AS p_normal_a, ROUND(p_b, 6) AS p_normal_b, is_normal FROM sf""",
    "bootstrap_median_ci": _S + _MEDIANS + " SELECT g AS c_mktsegment, ROUND(ci_lower, 0) AS ci_lower, ROUND(ci_upper, 0) AS ci_upper FROM bci",
    "loess_smooth": _LOESS,
    "brown_forsythe": _S + _LEVENE + """ SELECT c_mktsegment, n_a, n_b, ROUND(levene_f, 6) AS levene_f,
      ROUND(levene_p, 6) AS levene_p, levene_p >= 0.05 AS equal_var FROM lev""",
    "t_test": _M + _LEVENE + _TTP + """ SELECT c_mktsegment, test_name, n_a, n_b, ROUND(statistic, 6) AS statistic,
      ROUND(df, 6) AS df, ROUND(p, 6) AS p FROM tt""",
    "cohens_d": _M + f""", d AS (SELECT *, mean_b - mean_a AS diff, {_POOLED} AS pooled, (n_a + n_b - 2)::DOUBLE AS df FROM m),
      e AS (SELECT *, sqrt(pooled * (1.0 / n_a + 1.0 / n_b)) * {t_quantile_sql('df')} AS margin FROM d)
      SELECT c_mktsegment, ROUND(diff / sqrt(pooled), 6) AS effect_size, ROUND(diff, 2) AS diff,
      ROUND(diff - margin, 2) AS ci_lower, ROUND(diff + margin, 2) AS ci_upper FROM e""",
    "power_analysis": _M + _POWER,
    "mann_whitney": _S + _MWU + """ SELECT c_mktsegment, n_a, n_b, statistic, ROUND(z, 6) AS z, ROUND(p, 6) AS p,
      ROUND(effect_size, 6) AS effect_size FROM mw""",
    "before_after": _M + _SHAPIRO + _MEDIANS + _LEVENE + _TTP + _MWU + f""", ttc AS (SELECT *, (mean_b - mean_a) - se * {t_quantile_sql('df')} AS t_lower,
        (mean_b - mean_a) + se * {t_quantile_sql('df')} AS t_upper FROM tt) SELECT tt.c_mktsegment,
      CASE WHEN is_normal THEN test_name ELSE 'Mann-Whitney U' END AS test_name,
      ROUND(CASE WHEN is_normal THEN tt.statistic ELSE mw.statistic END, 6) AS statistic,
      ROUND(CASE WHEN is_normal THEN tt.p ELSE mw.p END, 6) AS p,
      ROUND(CASE WHEN is_normal THEN tt.effect_size ELSE mw.effect_size END, 6) AS effect_size,
      CASE WHEN is_normal THEN 'd' ELSE 'r' END AS effect_kind,
      ROUND(CASE WHEN is_normal THEN t_lower ELSE ci_lower END, 0) AS ci_lower, ROUND(CASE WHEN is_normal THEN t_upper ELSE ci_upper END, 0) AS ci_upper, tt.n_a, tt.n_b, ROUND(mean_a, 2) AS mean_a,
      ROUND(mean_b, 2) AS mean_b, 'ok' AS status
      FROM ttc tt JOIN sf ON tt.c_mktsegment = sf.g JOIN bci ON tt.c_mktsegment = bci.g JOIN mw ON tt.c_mktsegment = mw.c_mktsegment""",
    "association": f"""WITH c AS (SELECT l_returnflag, COUNT(*) AS n, {_CORR_X} AS r FROM lineitem GROUP BY 1)
      SELECT l_returnflag, n, ROUND(r, 6) AS pearson_r, ROUND({_corr_p('r', 'n')}, 6) AS pearson_p,
      ROUND(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS pearson_ci_lower,
      ROUND(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS pearson_ci_upper FROM c""",
    "spearman": _SPEARMAN,
    "diff_association": _DIFF,
    "partial_correlation": _PARTIAL2,
    "vif": """SELECT l_returnflag, COUNT(*) AS n, ROUND(1 / (1 - pow(corr(l_quantity, l_discount), 2)), 6) AS vif_x
      FROM lineitem GROUP BY 1""",
    "ols_r2": """WITH c AS (SELECT l_returnflag, COUNT(*) AS n, corr(l_quantity, l_extendedprice) AS xy,
      corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY 1)
      SELECT l_returnflag, n, ROUND((xy * xy + yz * yz - 2 * xy * yz * xz) / (1 - xz * xz), 6) AS r_squared FROM c""",
    "adf_test": _ADF,
    "seasonal_strength": _SEASONAL,
    "bh_fdr": _S + f""", m AS ({_moments_sql('c_mktsegment, c_nationkey')}),
      t AS (SELECT c_mktsegment, c_nationkey, (n_a + n_b - 2)::DOUBLE AS df,
        (mean_b - mean_a) / sqrt({_POOLED} * (1.0 / n_a + 1.0 / n_b)) AS statistic FROM m WHERE n_a >= 3 AND n_b >= 3),
      p AS (SELECT c_mktsegment, c_nationkey, {t_p_sql('statistic', 'df')} AS p FROM t),
      r AS (SELECT *, COUNT(*) OVER (PARTITION BY c_mktsegment) AS family_size,
        row_number() OVER (PARTITION BY c_mktsegment ORDER BY p) AS rank FROM p)
      SELECT c_mktsegment, c_nationkey, ROUND(p, 6) AS p, ROUND(least(1.0, MIN(p * family_size / rank) OVER (PARTITION BY c_mktsegment ORDER BY p
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, family_size FROM r""",
    "naive_ate": _X + f""", {NAIVE_SQL} SELECT 'all' AS sample, n_b AS n_treated, n_a AS n_control, ROUND(estimate, 2) AS estimate,
      ROUND(statistic, 6) AS statistic, ROUND({t_p_sql('statistic', '(n_a + n_b - 2)::DOUBLE')}, 6) AS p_value FROM naive""",
    "noise_scan": _X + f""", {NOISE_CTES} SELECT candidate, n, ROUND(r, 6) AS r, ROUND(p, 6) AS p, ROUND(q, 6) AS q,
      p < 0.05 AS naive_discovery, q < 0.05 AS fdr_discovery FROM noise""",
    "stratified_ate": _X + f""", {STRATA_CTES} SELECT strata, n_treated, n_control, ROUND(att, 2) AS att,
      ROUND(att_se, 2) AS att_se, ROUND(ate, 2) AS ate, ROUND(ate_se, 2) AS ate_se FROM strata""",
    "estimator_scoreboard": _X + f""", {NAIVE_SQL}, {NOISE_CTES}, {STRATA_CTES},
      fd AS (SELECT COUNT(*) FILTER (WHERE p < 0.05) AS d FROM noise)
      SELECT 'naive' AS method, 0.0::DOUBLE AS truth, ROUND(estimate, 2) AS estimate, ROUND(abs(estimate), 2) AS absolute_error,
        2 + 2 * d AS violations, 1.0::DOUBLE AS hallucination_rate, d AS false_discoveries FROM naive, fd
      UNION ALL SELECT 'stratified', 0.0, ROUND(att, 2), ROUND(abs(att), 2), 0, 0.0, 0 FROM strata""",
    "run_hypotheses": _HYPOTHESES,
}
