"""Data-quality checks; every check yields ``check, column, severity, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, NEGATIVE_CHECK_ROLES, NULL_CHECK_ROLES
from plumbline.functions.numeric import as_text, numeric_columns, ratio


def _record(check: str, column: str | None, severity: Column, value: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        severity.alias("severity"),
        value.cast("double").alias("value"),
    )


def check_nulls(df: DataFrame, roles: dict[str, str], max_null_rate: float = DEFAULTS.max_null_rate) -> DataFrame:
    """Null rate of date, metric, quantity and price columns, in one pass.

    Any null is a warning; a rate above ``max_null_rate`` is blocking.
    """
    aggregates, records = _null_parts(roles, max_null_rate)
    return df.agg(*aggregates).select(F.inline(F.array(*records)))


def _null_parts(roles: dict[str, str], max_null_rate: float) -> tuple[list[Column], list[Column]]:
    """Aggregates of the null check and the result records made from them."""
    columns = [c for c, role in roles.items() if role in NULL_CHECK_ROLES]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    records = [] if columns else [_record("check_nulls", None, F.lit("info"), F.lit(None))]
    for i, c in enumerate(columns):
        aggregates.append(F.count(F.col(f"`{c}`")).alias(f"filled{i}"))
        rate = ratio(F.col("rows") - F.col(f"filled{i}"), F.col("rows"))
        severity = F.when(rate > max_null_rate, "blocking").when(rate > 0, "warning").otherwise("info")
        records.append(_record("check_nulls", c, severity, rate))
    return aggregates, records


def check_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row.

    Equal rows collapse on the map side, so a row copied very often does not
    load one task.
    """
    keys = [as_text(df, f.name) if f.dataType.simpleString().startswith(("map", "variant")) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    copies = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    total = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    severity = F.when(F.col("extra") > 0, "warning").otherwise("info")
    return total.select(F.inline(F.array(_record("check_duplicates", None, severity, F.col("extra")))))


def check_negatives(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Count of negative values per numeric metric, price and quantity column."""
    aggregates, records = _negative_parts(df, roles)
    return df.agg(F.count(F.lit(1)), *aggregates).select(F.inline(F.array(*records)))


def _negative_parts(df: DataFrame, roles: dict[str, str]) -> tuple[list[Column], list[Column]]:
    numeric = set(numeric_columns(df))
    columns = [c for c, role in roles.items() if role in NEGATIVE_CHECK_ROLES and c in numeric]
    aggregates = [F.count_if(F.col(f"`{c}`") < 0).alias(f"below{i}") for i, c in enumerate(columns)]
    records = [] if columns else [_record("check_negatives", None, F.lit("info"), F.lit(None))]
    for i, c in enumerate(columns):
        severity = F.when(F.col(f"below{i}") > 0, "warning").otherwise("info")
        records.append(_record("check_negatives", c, severity, F.col(f"below{i}")))
    return aggregates, records


def quality_report(
    df: DataFrame, roles: dict[str, str], max_null_rate: float = DEFAULTS.max_null_rate
) -> DataFrame:
    """All checks, with the worst severity of each check beside its columns.

    Null and negative counts come from one pass over the table.
    """
    null_counts, null_records = _null_parts(roles, max_null_rate)
    negative_counts, negative_records = _negative_parts(df, roles)
    counted = df.agg(*null_counts, *negative_counts).select(F.inline(F.array(*null_records, *negative_records)))
    rows = counted.unionByName(check_duplicates(df))
    rank = F.when(F.col("severity") == "blocking", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    # At most one row per column of the table in a check.
    worst = F.max(rank).over(Window.partitionBy("check"))
    overall = F.when(worst == 2, "blocking").when(worst == 1, "warning").otherwise("info")
    return rows.withColumn("check_severity", overall)


def require_plottable(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The data itself if it can be plotted; an error for empty or non-finite data."""
    if df.isEmpty():
        raise ValueError("chart data is empty")
    bad = check_finite(df, key, columns).first()
    if bad is not None:
        raise ValueError(f"non-finite value in {bad['column']} at {key}={bad[key]}: {bad['reason']}")
    return df


def check_finite(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values that cannot be plotted: one row per NaN or infinite cell."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    bad = df.select(F.col(key), F.inline(F.array(*cells))).where(F.isnan("v") | (F.abs("v") == float("inf")))
    reason = F.when(F.isnan("v"), "nan").when(F.col("v") > 0, "inf").otherwise("-inf")
    return bad.select(key, "column", reason.alias("reason"))
