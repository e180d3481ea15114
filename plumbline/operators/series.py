"""Time-series diagnostics, many series per job.

Series are calendar buckets (rows are summed per hour, day, ... first), so the
length of one series is bounded by the time span, not by the number of rows.
Long series are cut into blocks that carry the neighbours they need: lags for
the Dickey-Fuller test, windows for the smooths.  Results do not depend on the
length of the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import dist, loess
from plumbline.functions.numeric import join_groups, ratio
from plumbline.functions.ordered import blocks_with_halo, positions, value_positions
from plumbline.session import cut_lineage

#: Points of a series that one task handles.
BLOCK = 65_536
#: Rows whose lags are laid out at a time.
ROWS = 4_096


def bucketed_series(df: DataFrame, time: str, unit: str, value: str, series: list[str]) -> DataFrame:
    """Sum of ``value`` per series and calendar unit; gaps are filled with 0."""
    sums = df.groupBy(*series, F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("value")
    )
    spans = sums.groupBy(*series).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    calendar = spans.select(*series, F.explode(F.expr(f"sequence(_lo, _hi, interval 1 {unit})")).alias("t"))
    return join_groups(calendar, sums, [*series, "t"], "left").select(
        *series, "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


def _numbered(points: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Present values as ``y`` with their place ``pos`` and the length ``size`` and mean ``centre`` of their series."""
    rows = points.where(F.col(value).isNotNull()).select(*series, order, F.col(value).cast("double").alias("y"))
    placed = positions(rows, series, [order])
    totals = placed.groupBy(*series).agg(F.count(F.lit(1)).alias("size"), F.avg("y").alias("centre"))
    return join_groups(placed, totals, series)


def _most_lags(n: Column) -> Column:
    """Lagged differences that the search goes up to: a fourth root of the length (Schwert's rule)."""
    return F.least(F.floor(n / 2) - 2, F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))).cast("int")


def _swept(gram: np.ndarray, k: int) -> np.ndarray:
    """Cross moments with the part that column ``k`` explains taken out."""
    return gram - np.outer(gram[:, k], gram[k]) / gram[k, k] if gram[k, k] > 0 else gram


def _dickey_fuller(gram: np.ndarray, head: np.ndarray, n: int) -> tuple[float, int, int] | None:
    """tau, lags and observations from the cross moments of (1, differences back, level, difference).

    ``gram`` covers the rows that have all lags, ``head`` are the first values of
    the series.  Each column is swept once, which gives the residuals of every
    number of lags; the least AIC wins and is fitted on all rows it can use.
    """
    most, level, target = len(gram) - 3, len(gram) - 2, len(gram) - 1
    rows, scores, swept = n - most - 1, [], gram
    for lags in range(most + 1):
        swept = _swept(swept, lags)
        left = swept[target, target] - (swept[level, target] ** 2 / swept[level, level] if swept[level, level] > 0 else 0.0)
        scores.append(rows * np.log(max(left, 1e-300) / rows) + 2 * (lags + 2) if rows > lags + 2 else np.inf)
    lags = int(np.argmin(scores))
    kept = [*range(lags + 1), level, target]
    own = gram[np.ix_(kept, kept)].copy()
    steps = np.diff(head)
    for t in range(lags + 1, most + 1):
        x = np.array([1.0, *steps[t - 2 :: -1][:lags], head[t - 1], steps[t - 1]]) if lags else np.array([1.0, head[t - 1], steps[t - 1]])
        own += np.outer(x, x)
    m = n - lags - 1
    for k in range(lags + 1):
        own = _swept(own, k)
    if own[-2, -2] <= 0 or m <= lags + 2:
        return None
    slope = own[-2, -1] / own[-2, -2]
    error = (own[-1, -1] - slope * own[-2, -1]) / (m - lags - 2) / own[-2, -2]
    return (float(slope / np.sqrt(error)), lags, m) if error > 0 else None


def adf_test(points: DataFrame, series: list[str], order: str, value: str, period: int = 12, block: int = BLOCK) -> DataFrame:
    """Dickey-Fuller test with constant; the number of lagged differences has the least AIC.

    Blocks of a series, with the rows before them that lags reach back to, give
    one matrix of cross moments; the matrices are summed by cell.  Series shorter
    than two periods come back with an error.
    """
    rows = cut_lineage(_numbered(points, series, order, value).withColumn("lags", _most_lags(F.col("size"))))
    usable = rows.where("lags >= 0")
    pieces = blocks_with_halo(usable, block, F.col("lags") + 1, F.lit(0), F.col("size"))
    names = [f"s{i}" for i in range(len(series))]
    kinds = [T.StructField(n, points.schema[c].dataType) for n, c in zip(names, series, strict=True)]

    def moments(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        most, first = int(frame["lags"].iloc[0]), int(frame["pos"].iloc[0])
        y, start = frame["y"].to_numpy(float), int(frame["block"].iloc[0]) * block
        steps = np.diff(y)
        # Places of the targets in ``y``: own rows that have all lags.
        t = np.arange(max(start, most + 1) - first, len(y))
        out = frame[names].head(1).copy()
        if len(t) == 0 or t[0] < 1:
            return out.head(0).assign(gram=pd.Series(dtype=object))
        gram = np.zeros((most + 3, most + 3))
        for few in np.array_split(t, len(t) // ROWS + 1):
            x = np.stack([np.ones(len(few)), *(steps[few - 1 - k] for k in range(1, most + 1)), y[few - 1], steps[few - 1]])
            gram += x @ x.T
        out["gram"] = [gram.ravel()]
        return out

    named = pieces.select(*[F.col(c).alias(n) for n, c in zip(names, series, strict=True)], "block", "pos", "lags", (F.col("y") - F.col("centre")).alias("y"))
    grams = named.groupBy(*names, "block").applyInPandas(moments, T.StructType([*kinds, T.StructField("gram", T.ArrayType(T.DoubleType()))]))
    cells = grams.select(*names, F.posexplode("gram").alias("at", "v")).groupBy(*names, "at").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("gram"))
    whole = whole.withColumnsRenamed(dict(zip(names, series, strict=True)))
    starts = usable.where("pos <= lags").groupBy(*series).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("y") - F.col("centre")).alias("y")))), lambda c: c["y"]).alias("head")
    )
    result_type = T.StructType([T.StructField("tau", T.DoubleType()), T.StructField("used_lag", T.IntegerType()), T.StructField("m", T.LongType())])

    @F.pandas_udf(result_type)
    def solved(gram: pd.Series, head: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = []
        for g, h, size in zip(gram, head, n, strict=True):
            side = int(round(np.sqrt(len(g))))
            found.append(_dickey_fuller(np.asarray(g, float).reshape(side, side), np.asarray(h, float), int(size)) or (None, None, None))
        return pd.DataFrame(found, columns=["tau", "used_lag", "m"]).astype({"tau": "float64", "used_lag": "Int32", "m": "Int64"})

    sizes = rows.groupBy(*series).agg(F.max("size").alias("n"))
    fitted = join_groups(join_groups(whole, starts, series), sizes, series).select(*series, solved("gram", "head", "n").alias("r"))
    joined = join_groups(sizes, fitted, series, "left")
    long_enough = F.col("n") >= 2 * period
    m = F.col("r.m").cast("double")
    c0, c1, c2, c3 = dist.DF_CRITICAL_5
    result = joined.select(
        *series,
        "n",
        F.when(long_enough, F.col("r.m")).alias("m"),
        F.when(long_enough, F.col("r.used_lag")).alias("used_lag"),
        F.when(long_enough & ~F.isnan("r.tau"), F.col("r.tau")).alias("tau"),
        F.when(long_enough, F.lit(c0) + ratio(F.lit(c1), m) + ratio(F.lit(c2), m**2) + ratio(F.lit(c3), m**3)).alias("critical_5"),
        F.when(long_enough, "ok").otherwise("error").alias("status"),
        F.when(~long_enough, "series too short").alias("error"),
    )
    return result.withColumn("adf_p_value", dist.dickey_fuller_p_value(F.col("tau"))).withColumn(
        "is_stationary", F.col("adf_p_value") < 0.05
    )


def adf_one_lag(points: DataFrame, series: list[str], order: str, value: str, period: int = 12) -> DataFrame:
    """Dickey-Fuller test with constant and exactly one lagged difference.

    Series shorter than two periods come back with an error.
    """
    w = Window.partitionBy(*series).orderBy(order)
    steps = (
        points.where(F.col(value).isNotNull())
        .withColumn("_level", F.lag(value).over(w))
        .withColumn("_dy", F.col(value) - F.col("_level"))
        .withColumn("_ldy", F.lag("_dy").over(w))
    )
    ready = F.col("_ldy").isNotNull()
    y, a, b = (F.when(ready, F.col(c)) for c in ("_dy", "_level", "_ldy"))
    sums = steps.groupBy(*series).agg(
        F.count(value).alias("n"),
        F.count(y).alias("m"),
        F.covar_pop(a, a).alias("s11"),
        F.covar_pop(b, b).alias("s22"),
        F.covar_pop(a, b).alias("s12"),
        F.covar_pop(a, y).alias("s1y"),
        F.covar_pop(b, y).alias("s2y"),
        F.covar_pop(y, y).alias("syy"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    b1 = ratio(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = ratio(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    residual = F.col("syy") - b1 * F.col("s1y") - b2 * F.col("s2y")
    variance = ratio(residual, F.col("m") - 3) * ratio(F.col("s22"), det)
    long_enough = F.col("n") >= 2 * period
    m = F.col("m").cast("double")
    c0, c1, c2, c3 = dist.DF_CRITICAL_5
    result = sums.select(
        *series,
        "n",
        "m",
        F.when(long_enough & (F.col("m") > 3), ratio(b1, F.sqrt(variance))).alias("tau"),
        (F.lit(c0) + ratio(F.lit(c1), m) + ratio(F.lit(c2), m**2) + ratio(F.lit(c3), m**3)).alias("critical_5"),
        F.when(long_enough, "ok").otherwise("error").alias("status"),
        F.when(~long_enough, "series too short").alias("error"),
    )
    return result.withColumn("adf_p_value", dist.dickey_fuller_p_value(F.col("tau"))).withColumn(
        "is_stationary", F.col("adf_p_value") < 0.05
    )


def seasonal_strength(points: DataFrame, series: list[str], order: str, value: str, period: int = 12) -> DataFrame:
    """Share of the detrended variance that repeats with the period.

    Classical decomposition (centred moving average, phase means): a set of
    window and group aggregates.  ``robust_strength`` is not moved by outliers.
    """
    w = Window.partitionBy(*series).orderBy(order)
    half = period // 2
    wide = w.rowsBetween(-half, half)
    inner = w.rowsBetween(-half + 1, half - 1) if period % 2 == 0 else wide
    numbered = points.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1)
    if period % 2 == 0:
        smooth = (F.sum(value).over(wide) + F.sum(value).over(inner)) / (2.0 * period)
    else:
        smooth = F.sum(value).over(wide) / float(period)
    full = F.count(value).over(wide) == 2 * half + 1
    detrended = numbered.withColumn("_phase", F.col("_i") % period).withColumn(
        "_d", F.when(full, F.col(value) - smooth)
    )
    phases = detrended.groupBy(*series, "_phase").agg(F.avg("_d").alias("_raw"))
    means = phases.groupBy(*series).agg(F.avg("_raw").alias("_centre"))
    seasonal = join_groups(phases, means, series).select(*series, "_phase", (F.col("_raw") - F.col("_centre")).alias("_s"))
    parts = join_groups(detrended, seasonal, [*series, "_phase"])
    sums = parts.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(F.col("_d") - F.col("_s")).alias("var_resid"),
        F.var_pop("_d").alias("var_both"),
    )
    long_enough = F.col("n") >= 2 * period
    strength = F.coalesce(F.greatest(F.lit(0.0), 1.0 - ratio(F.col("var_resid"), F.col("var_both"))), F.lit(0.0))
    return sums.select(
        *series,
        "n",
        F.when(long_enough, strength).alias("seasonal_strength"),
        F.when(long_enough, "ok").otherwise("error").alias("status"),
    )


def _in_pieces(rows: DataFrame, series: list[str], reach: int, block: int, out: str, each) -> DataFrame:
    """``each(piece, own)`` on blocks of every series with ``reach`` rows around them.

    ``piece`` is a frame by rising ``pos``; it returns it with its columns
    replaced, and only the own rows of the block are kept.
    """
    pieces = blocks_with_halo(rows, block, F.lit(reach), F.lit(reach), F.col("size"))
    names = [f.split()[0] for f in out.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos").reset_index(drop=True)
        own = frame["pos"] // block == frame["block"]
        return each(frame)[own][[*series, *names]]

    kinds = T.StructType([*rows.select(*series).schema.fields, *T.StructType.fromDDL(out).fields])
    return pieces.groupBy(*series, "block").applyInPandas(run, kinds)


def _with_weights(rows: DataFrame, series: list[str]) -> DataFrame:
    """Adds the bisquare weight of |resid| by its exact median per series."""
    sizes = rows.groupBy(*series, F.abs("resid").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    medians = value_positions(sizes, series, {"median": 0.5})
    share = ratio(F.abs("resid"), 6.0 * F.col("median"))
    weight = F.when((F.col("median") == 0) | (share <= 0.001), 1.0).when(share <= 0.999, F.pow(1.0 - share * share, F.lit(2.0))).otherwise(0.0)
    return join_groups(rows, medians, series).withColumn("weight", weight).drop("median")


def loess_smooth(points: DataFrame, series: list[str], order: str, value: str, window: int, rounds: int = 1, block: int = BLOCK) -> DataFrame:
    """Adds ``smooth``, ``resid`` and ``weight``: local lines over ``window`` points, ``rounds`` times re-weighted by bisquare."""
    rows = cut_lineage(_numbered(points, series, order, value).select(*series, order, "pos", "y", "size", F.lit(1.0).alias("weight")))
    out = f"pos long, {order} {rows.schema[order].dataType.simpleString()}, y double, size long, smooth double, resid double"

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame["y"].to_numpy(float)
        frame["smooth"] = loess.loess(y, window, int(frame["size"].iloc[0]), frame["weight"].to_numpy(float))
        frame["resid"] = frame["y"] - frame["smooth"]
        return frame

    for k in range(rounds + 1):
        rows = cut_lineage(_in_pieces(rows, series, window, block, out, each))
        rows = _with_weights(rows, series) if k < rounds else rows.withColumn("weight", F.lit(None).cast("double"))
    return rows.select(*series, order, F.col("y").alias(value), "smooth", "resid")


def stl(points: DataFrame, series: list[str], order: str, value: str, period: int = 12, inner: int = 2, outer: int = 15, block: int = BLOCK) -> DataFrame:
    """Robust seasonal-trend decomposition by LOESS: ``season``, ``trend``, ``resid`` and ``weight`` of every point.

    A series that fits one block is decomposed in its task.  Longer ones go
    through the outer rounds together: blocks carry as many neighbours as a round
    can reach, and the median of the residuals, which sets the weights, is taken
    over the whole series between rounds.  Series shorter than two periods are left out.
    """
    block = -(-block // period) * period
    rows = cut_lineage(_numbered(points, series, order, value).where(F.col("size") >= 2 * period))
    rows = rows.select(*series, order, "pos", "y", "size", *[F.lit(0.0).alias(c) for c in ("season", "trend", "resid")], F.lit(1.0).alias("weight"))
    fields = f"{order} {rows.schema[order].dataType.simpleString()}, pos long, y double, size long, season double, trend double, resid double"

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame["y"].to_numpy(float)
        frame["season"], frame["trend"], frame["weight"] = loess.decompose(y, period, inner=inner, outer=outer)
        frame["resid"] = frame["y"] - frame["season"] - frame["trend"]
        return frame

    short = _in_pieces(rows.where(F.col("size") <= block), series, 0, block, fields + ", weight double", whole)
    long = cut_lineage(rows.where(F.col("size") > block))
    if long.isEmpty():
        return short.select(*series, order, F.col("y").alias(value), "season", "trend", "resid", "weight")

    def one_round(frame: pd.DataFrame) -> pd.DataFrame:
        y, trend, weights = (frame[c].to_numpy(float) for c in ("y", "trend", "weight"))
        for _ in range(inner):
            season, trend = loess.inner_step(y, trend, weights, period, total=int(frame["size"].iloc[0]))
        frame["season"], frame["trend"], frame["resid"] = season, trend, y - season - trend
        return frame

    for k in range(outer + 1):
        long = cut_lineage(_in_pieces(long, series, loess.halo(period, inner), block, fields + ", weight double", one_round))
        if k < outer:
            long = _with_weights(long.drop("weight"), series)
    both = short.unionByName(long)
    return both.select(*series, order, F.col("y").alias(value), "season", "trend", "resid", "weight")


def robust_strength(points: DataFrame, series: list[str], order: str, value: str, period: int = 12, block: int = BLOCK) -> DataFrame:
    """Share of the detrended variance that the robust seasonal component explains."""
    parts = stl(points, series, order, value, period, block=block)
    sums = parts.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("resid").alias("left"), F.var_pop(F.col("season") + F.col("resid")).alias("both")
    )
    strength = F.when(F.col("both") > 0, F.greatest(F.lit(0.0), 1.0 - ratio(F.col("left"), F.col("both")))).otherwise(0.0)
    return sums.select(*series, "n", strength.alias("seasonal_strength"))


def analyze_timeseries(points: DataFrame, series: list[str], order: str, value: str, period: int = 12, robust: bool = True) -> DataFrame:
    """Stationarity and seasonality side by side; ``robust`` chooses between STL and phase means."""
    strength = robust_strength if robust else seasonal_strength
    seasonal = strength(points, series, order, value, period).select(*series, "seasonal_strength")
    return join_groups(adf_test(points, series, order, value, period), seasonal, series, "left")
