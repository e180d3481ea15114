"""Associations between columns, many groups per job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import DEFAULTS
from plumbline.functions import dist
from plumbline.functions.numeric import join_groups, present, ratio
from plumbline.functions.ordered import average_rank, cumulative_counts, ordered_chunks, previous_values
from plumbline.operators.explore import pearson
from plumbline.session import cut_lineage

# Fixed value: upper 2.5 % point of the normal distribution.
_Z975 = 1.959963984540054


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation from t with n - 2 degrees of freedom."""
    t = r * F.sqrt(ratio(n - 2, 1 - r * r))
    return F.when(present(r), F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(dist.t_p_value(t, n - 2)))


def association(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Pearson r with p and 95 % interval on rows where both values are present (not null, not NaN)."""
    complete = df.where(present(F.col(x)) & present(F.col(y)))
    sums = complete.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("pearson_r")
    )
    n, r = F.col("n"), F.col("pearson_r")
    half = F.lit(_Z975) / F.sqrt(n - 3)
    inside = (n > 3) & (F.abs(r) < 1)
    return (
        sums.withColumn("pearson_p", F.when(n >= 3, correlation_p(r, n)))
        .withColumn("pearson_ci_lower", F.when(inside, F.tanh(F.atanh(r) - half)))
        .withColumn("pearson_ci_upper", F.when(inside, F.tanh(F.atanh(r) + half)))
        .withColumn("status", F.when(n >= 3, "ok").otherwise("error"))
        .withColumn("error", F.when(n < 3, "too few rows"))
    )


def spearman(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Equal pairs collapse first; ranks are found on the distinct values and
    joined back to the distinct pairs.
    """
    pairs = cut_lineage(
        df.select(*groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .where(present(F.col("_x")) & present(F.col("_y")))
        .groupBy(*groups, "_x", "_y")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )

    def ranks(column):
        counts = pairs.groupBy(*groups, F.col(column).alias("value")).agg(F.sum("cnt").alias("cnt"))
        ranked = cumulative_counts(counts, groups)
        return ranked.select(*groups, F.col("value").alias(column), average_rank().alias(f"{column}_rank"))

    ranked = join_groups(join_groups(pairs, ranks("_x"), [*groups, "_x"]), ranks("_y"), [*groups, "_y"])
    c, rx, ry = F.col("cnt"), F.col("_x_rank"), F.col("_y_rank")
    sums = ranked.groupBy(*groups).agg(
        F.sum("cnt").alias("n"),
        *[F.sum(c * e).alias(k) for k, e in {"sx": rx, "sy": ry, "sxx": rx * rx, "syy": ry * ry, "sxy": rx * ry}.items()],
    )
    n = F.col("n").cast("double")
    covariance = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = F.sqrt(F.col("sxx") - F.col("sx") ** 2 / n) * F.sqrt(F.col("syy") - F.col("sy") ** 2 / n)
    result = sums.select(*groups, "n", ratio(covariance, spread).alias("spearman_r"))
    return result.withColumn("spearman_p", F.when(F.col("n") >= 3, correlation_p(F.col("spearman_r"), F.col("n"))))


def diff_association(df: DataFrame, x: str, y: str, groups: list[str], order: list[str]) -> DataFrame:
    """Pearson r of row-to-row differences along an explicit order.

    ``order`` must be unique within a group.
    """
    rows = df.where(present(F.col(x)) & present(F.col(y))).select(
        *groups, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    stepped = previous_values(ordered_chunks(rows, groups, order), groups, order, ["_x", "_y"])
    deltas = stepped.select(
        *groups, (F.col("_x") - F.col("prev__x")).alias("dx"), (F.col("_y") - F.col("prev__y")).alias("dy")
    )
    result = association(deltas, "dx", "dy", groups)
    enough = F.col("n") > 2
    return result.select(
        *groups,
        F.col("n").alias("diff_n"),
        F.when(enough, F.col("pearson_r")).alias("diff_pearson_r"),
        F.when(enough, F.col("pearson_p")).alias("diff_pearson_p"),
    )


def full_association(df: DataFrame, x: str, y: str, groups: list[str], order: list[str]) -> DataFrame:
    """Pearson, Spearman and difference correlation side by side."""
    ranks = spearman(df, x, y, groups).drop("n")
    steps = diff_association(df, x, y, groups, order).drop("diff_n")
    return join_groups(join_groups(association(df, x, y, groups), ranks, groups, "left"), steps, groups, "left")


_PARTIAL_NAMES = ["raw_effect", "controlled_effect", "vif_x", "r_squared"]
_PARTIAL = T.StructType([T.StructField(name, T.DoubleType()) for name in _PARTIAL_NAMES])


@F.pandas_udf(_PARTIAL)
def _from_correlations(upper: pd.Series) -> pd.DataFrame:
    """Partial r, VIF and R2 from the upper triangle of a correlation matrix (x, y, controls)."""
    out = []
    for cells in upper:
        values = [np.nan if v is None else float(v) for v in cells]
        size = int((1 + np.sqrt(1 + 8 * len(values))) / 2)
        matrix = np.eye(size)
        matrix[np.triu_indices(size, 1)] = values
        matrix = np.triu(matrix) + np.triu(matrix, 1).T
        try:
            inverse = np.linalg.inv(matrix)
            without_y = np.delete(np.delete(matrix, 1, 0), 1, 1)
            r = -inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1])
            out.append((matrix[0, 1], r, np.linalg.inv(without_y)[0, 0], 1.0 - 1.0 / inverse[1, 1]))
        except np.linalg.LinAlgError:
            out.append((matrix[0, 1], np.nan, np.nan, np.nan))
    return pd.DataFrame(out, columns=_PARTIAL_NAMES)


def controlled_association(df: DataFrame, x: str, y: str, controls: list[str], groups: list[str]) -> DataFrame:
    """Correlation of x and y given the controls, with VIF of x and R2 of y.

    All pairwise correlations come from one aggregation; the small matrix per
    group is inverted on the result table.
    """
    columns = [x, y, *controls]
    complete = df.select(*groups, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna(
        subset=[f"v{i}" for i in range(len(columns))]
    )
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    sums = complete.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[pearson(F.col(f"v{i}"), F.col(f"v{j}")) for i, j in pairs]).alias("_upper"),
    )
    k = len(controls)
    solved = sums.withColumn("_m", _from_correlations("_upper")).select(*groups, "n", "_m.*")
    usable = (F.col("n") >= k + 3) & ~F.isnan("controlled_effect")
    r = F.when(usable, F.col("controlled_effect"))
    half = F.lit(_Z975) / F.sqrt(F.col("n") - k - 3)
    wide_enough = F.col("n") > k + 3
    raw = F.abs("raw_effect")
    return (
        solved.withColumn("controlled_effect", r)
        .withColumn(
            "attenuation_ratio", F.when(raw > 1e-9, F.abs("controlled_effect") / raw).otherwise(F.lit(1.0))
        )
        .withColumn("p_value", correlation_p(F.col("controlled_effect"), F.col("n") - k))
        .withColumn("ci_lower", F.when(wide_enough, F.tanh(F.atanh("controlled_effect") - half)))
        .withColumn("ci_upper", F.when(wide_enough, F.tanh(F.atanh("controlled_effect") + half)))
        .withColumn("status", F.when(usable, "ok").otherwise("error"))
        .withColumn("error", F.when(~usable, "too few rows for the controls"))
    )
