"""Two-sample comparisons, many groups per job.

Every function takes a table with one row per observation, a value column and
a boolean column that is true for sample b.  Effects are b minus a.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import DEFAULTS
from plumbline.functions import dist, medians
from plumbline.functions.numeric import join_groups, ratio
from plumbline.functions.ordered import (
    CHUNK,
    average_rank,
    cumulative_counts,
    order_statistics,
)
from plumbline.session import cut_lineage

MIN_SAMPLE = 3


def _observations(df: DataFrame, value: str, is_b: Column, groups: list[str]) -> DataFrame:
    return df.select(
        *groups, F.col(value).cast("double").alias("value"), F.coalesce(is_b, F.lit(False)).alias("is_b")
    ).where("value is not null and not isnan(value)")


def two_sample_moments(df: DataFrame, value: str, is_b: Column, groups: list[str]) -> DataFrame:
    """Sizes, means, variances, skewness and kurtosis of both samples."""
    rows = _observations(df, value, is_b, groups)
    aggregates = []
    for side, mask in (("a", ~F.col("is_b")), ("b", F.col("is_b"))):
        v = F.when(mask, F.col("value"))
        aggregates += [
            F.count(v).alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            F.var_samp(v).alias(f"var_{side}"),
            F.skewness(v).alias(f"skew_{side}"),
            F.kurtosis(v).alias(f"kurt_{side}"),
        ]
    return rows.groupBy(*groups).agg(*aggregates)


def normality_gate(moments: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Jarque-Bera per side (in place of Shapiro-Wilk, which needs a full sort), at every size."""
    for side in "ab":
        n, s, k = (F.col(f"{c}_{side}") for c in ("n", "skew", "kurt"))
        jb = n / 6.0 * (s * s + k * k / 4.0)
        moments = moments.withColumn(f"jb_{side}", jb).withColumn(f"p_normal_{side}", F.exp(-jb / 2.0))
    rejected = (F.col("p_normal_a") < alpha) | (F.col("p_normal_b") < alpha)
    return moments.withColumn("is_normal", ~F.coalesce(rejected, F.lit(False)))


def value_counts(df: DataFrame, value: str, is_b: Column, groups: list[str]) -> DataFrame:
    """Distinct values with their count in either sample."""
    rows = _observations(df, value, is_b, groups)
    return rows.groupBy(*groups, "value").agg(
        F.count_if(~F.col("is_b")).alias("cnt_a"), F.count_if("is_b").alias("cnt_b"), F.count(F.lit(1)).alias("cnt")
    )


def _by_side(counts: DataFrame, groups: list[str]) -> DataFrame:
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"cnt_{s}").alias("cnt")) for s in "ab"]
    return counts.select(*groups, "value", F.inline(F.array(*sides))).where("cnt > 0")


def side_ranks(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct values of either sample with the number of smaller ones (``before``)."""
    return cumulative_counts(_by_side(counts, groups), [*groups, "side"])


def shapiro_francia(sides: DataFrame, groups: list[str], alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Normality of both sides: squared correlation of the ordered values with normal scores.

    Equal values share the score of their average rank.  The p-value uses
    Royston's approximation, published for 5 to 5,000 values and carried on
    beyond; fewer values and constant sides have none and count as normal.
    """
    keys = [*groups, "side"]
    cnt = F.col("cnt")
    totals = sides.groupBy(*keys).agg(F.sum("cnt").alias("n"), (F.sum(cnt * F.col("value")) / F.sum("cnt")).alias("mean"))
    score = dist.normal_quantile((average_rank() - 0.375) / (F.col("n") + 0.25))
    scored = join_groups(sides, totals, keys).withColumn("m", score).withColumn("d", F.col("value") - F.col("mean"))
    sums = scored.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(cnt * F.col("d") * F.col("d")).alias("dd"),
        F.sum(cnt * F.col("d") * F.col("m")).alias("dm"),
        F.sum(cnt * F.col("m")).alias("sm"),
        F.sum(cnt * F.col("m") * F.col("m")).alias("mm"),
    )
    w = ratio(F.col("dm") ** 2, F.col("dd") * (F.col("mm") - F.col("sm") ** 2 / F.col("n")))
    u = F.ln(F.col("n").cast("double"))
    v = F.ln(u)
    # Royston's published mean and deviation of ln(1 - W').
    mean, deviation = F.lit(-1.2725) + 1.0521 * (v - u), F.lit(1.0308) - 0.26758 * (v + ratio(F.lit(2.0), u))
    tested = sums.withColumn("w", w).withColumn("z", F.when(F.col("n") >= 5, ratio(F.ln(1.0 - F.col("w")) - mean, deviation)))
    half = dist.z_p_value(F.col("z")) / 2.0
    tested = tested.withColumn("half", half).withColumn("p", F.when(F.col("z") >= 0, F.col("half")).otherwise(1.0 - F.col("half")))

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    names = {"w": "w", "p": "p_normal"}
    wide = tested.groupBy(*groups).agg(*[of(s, c).alias(f"{name}_{s}") for c, name in names.items() for s in "ab"])
    rejected = F.coalesce(F.col("p_normal_a") < alpha, F.lit(False)) | F.coalesce(F.col("p_normal_b") < alpha, F.lit(False))
    return wide.withColumn("is_normal", ~rejected)


def brown_forsythe(sides: DataFrame, groups: list[str], alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Median-centred equal-variance test from the ranked values of both sides."""
    keys = [*groups, "side"]
    deviations = join_groups(sides, order_statistics(sides, keys, {"median": 0.5}), keys)
    z = F.abs(F.col("value") - F.col("median"))
    sides = deviations.groupBy(*groups, "side").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * z).alias("s1"),
        F.sum(F.col("cnt") * z * z).alias("s2"),
    )

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    wide = sides.groupBy(*groups).agg(
        *[of(s, c).alias(f"{c}_{s}") for s in "ab" for c in ("n", "s1", "s2")],
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    mean_a, mean_b = ratio(F.col("s1_a"), n_a), ratio(F.col("s1_b"), n_b)
    mean = ratio(F.col("s1_a") + F.col("s1_b"), n_a + n_b)
    between = n_a * (mean_a - mean) ** 2 + n_b * (mean_b - mean) ** 2
    within = F.col("s2_a") - n_a * mean_a**2 + F.col("s2_b") - n_b * mean_b**2
    statistic = ratio(between * (n_a + n_b - 2), within)
    result = wide.select(*groups, "n_a", "n_b", statistic.alias("levene_f"))
    result = result.withColumn("levene_p", dist.f_p_value(F.col("levene_f"), F.lit(1), F.col("n_a") + F.col("n_b") - 2))
    return result.withColumn("equal_var", F.coalesce(F.col("levene_p") >= alpha, F.lit(True)))


def t_test(moments: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Pooled or Welch t test, by ``equal_var``, with Cohen's d and the interval."""
    n_a, n_b, v_a, v_b = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    diff = F.col("mean_b") - F.col("mean_a")
    pooled = ratio((n_a - 1) * v_a + (n_b - 1) * v_b, n_a + n_b - 2)
    se_a, se_b = ratio(v_a, n_a), ratio(v_b, n_b)
    welch_df = ratio((se_a + se_b) ** 2, ratio(se_a**2, n_a - 1) + ratio(se_b**2, n_b - 1))
    se = F.when(F.col("equal_var"), F.sqrt(pooled * (1.0 / n_a + 1.0 / n_b))).otherwise(F.sqrt(se_a + se_b))
    enough = (n_a >= 2) & (n_b >= 2)
    result = (
        moments.withColumn("test_name", F.when(F.col("equal_var"), "Student's t-test").otherwise("Welch's t-test"))
        .withColumn("df", F.when(enough, F.when(F.col("equal_var"), (n_a + n_b - 2).cast("double")).otherwise(welch_df)))
        .withColumn("diff", diff)
        .withColumn("se", F.when(enough, se))
        .withColumn("statistic", ratio(F.col("diff"), F.col("se")))
        .withColumn("effect_size", F.when(enough, ratio(diff, F.sqrt(pooled))))
    )
    result = result.withColumn("p", dist.t_p_value(F.col("statistic"), F.col("df")))
    margin = dist.t_critical(alpha, F.col("df")) * F.col("se")
    return (
        result.withColumn("_margin", margin)
        .withColumn("ci_lower", F.col("diff") - F.col("_margin"))
        .withColumn("ci_upper", F.col("diff") + F.col("_margin"))
        .drop("_margin")
    )


def mann_whitney(counts: DataFrame, groups: list[str]) -> DataFrame:
    """U of sample b, tie-corrected normal p and rank-biserial effect."""
    ranked = cumulative_counts(counts, groups)
    t = F.col("cnt").cast("double")
    sums = ranked.groupBy(*groups).agg(
        F.sum("cnt_a").alias("n_a"),
        F.sum("cnt_b").alias("n_b"),
        F.sum(average_rank() * F.col("cnt_b")).alias("rank_sum_b"),
        F.sum(t**3 - t).alias("ties"),
    )
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    pairs = n_a * n_b
    sigma = F.sqrt(pairs / 12.0 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    result = sums.withColumn("statistic", F.col("rank_sum_b") - n_b * (n_b + 1) / 2.0)
    distance = F.abs(F.col("statistic") - pairs / 2.0) - 0.5
    result = result.withColumn("z", F.greatest(ratio(distance, sigma), F.lit(0.0))).withColumn(
        "effect_size", ratio(2.0 * F.col("statistic"), pairs) - 1.0
    )
    return result.withColumn("p", dist.z_p_value(F.col("z"))).select(
        *groups, "n_a", "n_b", "statistic", "z", "p", "effect_size"
    )


def bootstrap_median_ci(
    sides: DataFrame, groups: list[str], resamples: int = 1000, seed: int = 42, alpha: float = DEFAULTS.alpha
) -> DataFrame:
    """Percentile interval of the median difference b - a, seeded.

    The k-th smallest of n draws with replacement sits at sorted position
    ceil(n * U) where U is the k-th smallest of n uniforms, a beta variable.
    Drawing those positions gives bootstrap medians exactly, without making any
    resample: the cost is one ranking plus a few positions per replicate.
    """
    keys = [*groups, "side"]
    cumulative = sides
    sizes = cumulative.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    positions = _median_positions(sizes, keys, resamples, seed)
    starts = cumulative.groupBy(*keys, CHUNK).agg(F.min("before").alias("start"))
    # Chunks of a group as one sorted array: at most one entry per partition.
    borders = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", CHUNK))).alias("borders"))
    placed = (
        join_groups(positions, borders, keys)
        .withColumn("_in", F.expr("filter(borders, b -> b.start < position)"))
        .withColumn(CHUNK, F.element_at("_in", -1)[CHUNK])
        .select(*keys, CHUNK, "replicate", "part", F.col("position").alias("at"), F.lit(None).cast("double").alias("value"))
    )
    ends = cumulative.select(
        *keys, CHUNK, F.lit(None).cast("int").alias("replicate"), F.lit(None).cast("int").alias("part"),
        (F.col("before") + F.col("cnt")).alias("at"), "value",
    )
    # The first value whose cumulative count reaches the position.
    falling = Window.partitionBy(*keys, CHUNK).orderBy(F.desc("at"))
    ahead = falling.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.unionByName(ends).withColumn("hit", F.min("value").over(ahead)).where("replicate is not null")
    medians = found.groupBy(*keys, "replicate").agg(F.avg("hit").alias("median"))
    differences = medians.groupBy(*groups, "replicate").agg(
        (F.max(F.when(F.col("side") == "b", F.col("median"))) - F.max(F.when(F.col("side") == "a", F.col("median")))).alias("d")
    )
    # One row per replicate: `resamples` values per group, whatever the data size.
    return differences.groupBy(*groups).agg(
        F.percentile("d", F.lit(alpha / 2)).alias("ci_lower"),
        F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_upper"),
        F.count("d").alias("resamples"),
    )


def _median_positions(sizes: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """Sorted positions of the one or two middle draws of every replicate."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(n: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for size, state in zip(n, start, strict=True):
            rng = np.random.default_rng(int(state) & 0x7FFFFFFFFFFFFFFF)
            k = (size + 1) // 2
            first = rng.beta(k, size - k + 1, resamples)
            second = first
            if size % 2 == 0:
                rest = size - k
                second = 1.0 - (1.0 - first) * rng.random(resamples) ** (1.0 / rest)
            both = np.stack([first, second], axis=1).ravel()
            out.append(np.clip(np.ceil(both * size), 1, size).astype("int64"))
        return pd.Series(out)

    drawn = sizes.withColumn("_draws", draw(F.col("n"), F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])))
    return drawn.select(*keys, F.posexplode("_draws").alias("_i", "position")).select(
        *keys,
        F.floor(F.col("_i") / 2).cast("int").alias("replicate"),
        (F.col("_i") % 2).cast("int").alias("part"),
        "position",
    )


def exact_median_ci(sides: DataFrame, groups: list[str], alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Percentile interval of the median difference b - a over all possible resamples.

    Only values within a few standard deviations of the middle, some multiple of
    the root of the group's size, can be a resampled median; they meet in one
    task per group.
    """
    keys = [*groups, "side"]
    sizes = sides.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    middle, reach = F.col("n") / 2.0, F.sqrt("n") * (medians.REACH / 2.0) + 1.0
    near = (F.col("before") + F.col("cnt") >= middle - reach) & (F.col("before") <= middle + reach)
    rows = join_groups(sides, sizes, keys).where(near).select(*groups, "side", "value", "before", "cnt", "n")
    schema = T.StructType([*sides.select(*groups).schema.fields, T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())])

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[groups].head(1).copy()
        both = []
        for side in "ab":
            own = frame[frame["side"] == side].sort_values("value")
            if len(own):
                columns = (own[c].to_numpy(float) for c in ("value", "before", "cnt"))
                both += medians.bootstrap_median(*columns, int(own["n"].iloc[0]))
        for name, q in (("ci_lower", alpha / 2), ("ci_upper", 1 - alpha / 2)):
            out[name] = medians.difference_quantile(*both, q) if len(both) == 4 else np.nan
        return out

    found = rows.groupBy(*groups).applyInPandas(interval, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ci_lower", "ci_upper")})


def before_after(df: DataFrame, value: str, is_b: Column, groups: list[str], alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Compare two samples per group with the test their distribution calls for.

    Normal samples get a t test (pooled or Welch by the equal-variance test),
    others Mann-Whitney with the exact bootstrap interval of the median
    difference; ranks over both samples are made for those alone.  Groups with
    fewer than three values on a side come back with an error.
    """
    counts = cut_lineage(value_counts(df, value, is_b, groups))
    sides = side_ranks(counts, groups)
    gate = cut_lineage(shapiro_francia(sides, groups, alpha).select(*groups, "is_normal"))
    variance = brown_forsythe(sides, groups, alpha).select(*groups, "equal_var")
    moments = join_groups(two_sample_moments(df, value, is_b, groups), gate, groups, "left")
    tested = t_test(join_groups(moments, variance, groups, "left"), alpha)
    skewed = gate.where("not is_normal").select(*groups)
    ranks = mann_whitney(join_groups(counts, skewed, groups, "left_semi"), groups).select(
        *groups, F.struct("statistic", "p", "effect_size").alias("mw")
    )
    interval = exact_median_ci(join_groups(sides, skewed, groups, "left_semi"), groups, alpha).select(
        *groups, F.struct("ci_lower", "ci_upper").alias("boot")
    )
    joined = join_groups(join_groups(tested, ranks, groups, "left"), interval, groups, "left")
    usable = (F.col("n_a") >= MIN_SAMPLE) & (F.col("n_b") >= MIN_SAMPLE)

    def choose(name, source):
        return F.when(usable, F.when(F.col("is_normal"), F.col(name)).otherwise(F.col(f"{source}.{name}"))).alias(name)

    return joined.select(
        *groups,
        F.when(usable, F.when(F.col("is_normal"), F.col("test_name")).otherwise("Mann-Whitney U")).alias("test_name"),
        choose("statistic", "mw"),
        choose("p", "mw"),
        choose("effect_size", "mw"),
        F.when(usable, F.when(F.col("is_normal"), "d").otherwise("r")).alias("effect_kind"),
        choose("ci_lower", "boot"),
        choose("ci_upper", "boot"),
        "n_a",
        "n_b",
        "mean_a",
        "mean_b",
        F.when(usable, "ok").otherwise("error").alias("status"),
        F.when(~usable, "too few rows").alias("error"),
    )


def power_analysis(tests: DataFrame, alpha: float = DEFAULTS.alpha, target: float = DEFAULTS.target_power) -> DataFrame:
    """Power of the pooled t test for a table with ``effect_size, n_a, n_b``."""
    ratio_b = ratio(F.col("n_b"), F.col("n_a"))
    powered = tests.withColumn("ratio", ratio_b).withColumn(
        "power", F.coalesce(dist.power_value(F.col("effect_size"), F.col("n_a"), F.col("ratio"), alpha), F.lit(0.0))
    )
    return powered.withColumn("reaches_target", F.col("power") >= target)
