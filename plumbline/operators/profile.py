"""Column profiles, semantic types, role inference and summaries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import as_text, numeric_columns, present, ratio, type_class
from plumbline.functions.ordered import value_positions


def profile_columns(df: DataFrame, table_name: str = "dataset", exact: bool = True) -> DataFrame:
    """One row per column: counts, least and largest value from one aggregation.

    Exact distinct counts come from a second one over (column, value) pairs,
    which collapse before the shuffle; ``exact=False`` takes HyperLogLog
    sketches in the first instead.  An empty table has no profile.
    """
    fields = df.schema.fields
    aggregates = [F.count(F.lit(1)).alias("rows")]
    texts = df.select(
        *[
            (F.col(f"`{f.name}`") if isinstance(f.dataType, _ORDERED) else as_text(df, f.name)).alias(f"c{i}")
            for i, f in enumerate(fields)
        ]
    )
    for i in range(len(fields)):
        c = F.col(f"c{i}")
        aggregates += [
            F.count(c).alias(f"n{i}"),
            *([] if exact else [F.approx_count_distinct(c).alias(f"d{i}")]),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
        ]
    records = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(type_class(f.dataType)).alias("type"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            ratio(F.col("rows") - F.col(f"n{i}"), F.col("rows")).alias("null_rate"),
            (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_count"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
        )
        for i, f in enumerate(fields)
    ]
    profile = (
        texts.agg(*aggregates)
        .where("rows > 0")
        .select(F.lit(table_name).alias("table_name"), F.col("rows").alias("row_count"), F.inline(F.array(*records)))
    )
    if not exact:
        return profile
    # One row per column of the table on either side of this join.
    joined = profile.drop("distinct_count").join(_distinct_counts(df), "position", "left")
    return joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))).select(*profile.columns)


def _distinct_counts(df: DataFrame) -> DataFrame:
    """``position, distinct_count`` of the non-null values of every column.

    A cell travels as its position and two 64-bit hashes of its text, whatever
    the length of the text.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        text = as_text(df, f.name)
        if f.dataType.simpleString() in ("float", "double"):
            # Adding zero turns -0.0 into 0.0.
            text = (F.col(f"`{f.name}`") + F.lit(0.0)).cast("string")
        cells.append(F.when(text.isNotNull(), F.struct(F.lit(i).alias("position"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))))
    values = df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))).distinct()
    return values.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))


_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)


def profile_samples(df: DataFrame, limit: int = 5) -> DataFrame:
    """The first distinct non-null values of each column, as text in text order.

    Each task keeps the ``limit`` least values of a column while it reads, so a
    few rows per task and column are all that is moved.
    """
    names = df.columns

    def least(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[bytes]] = [set() for _ in names]
        for batch in parts:
            for i, own in enumerate(held):
                column = batch.column(i).drop_null().cast(pa.binary())
                for at in range(0, len(column), 1_024):
                    own.update(column.slice(at, 1_024).to_pylist())
                    if len(own) > limit:
                        held[i] = own = set(heapq.nsmallest(limit, own))
        rows = [(name, value) for name, own in zip(names, held, strict=True) for value in own]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary()).cast(pa.string())], ["column", "value"])

    texts = df.select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    order = Window.partitionBy("column").orderBy("value")
    top = texts.mapInArrow(least, "column string, value string").distinct()
    top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    trimmed = F.trim("value")
    return top.select(
        "column",
        "rank",
        F.when(F.length(trimmed) > 40, F.concat(F.substring(trimmed, 1, 37), F.lit("...")))
        .otherwise(trimmed)
        .alias("sample"),
    )


def semantic_types(profile: DataFrame) -> DataFrame:
    """Adds ``semantic_type``: date, boolean, id, metric, category or text."""
    named_id = F.lower("column").endswith("id")
    distinct = F.col("distinct_count")
    few = (distinct < 100) | (ratio(distinct, F.col("row_count")) < 0.05)
    numeric = F.when(distinct <= 2, "boolean").when(named_id, "id").otherwise("metric")
    other = F.when(few, "category").when(named_id, "id").otherwise("text")
    return profile.withColumn(
        "semantic_type",
        F.when(F.col("type") == "date", "date")
        .when(F.col("type") == "numeric", numeric)
        .when(F.col("type") == "boolean", "boolean")
        .otherwise(other),
    )


def infer_roles(typed_profile: DataFrame) -> DataFrame:
    """Business roles by ordered rules; columns without a role are left out.

    The windows run over the columns of one table, so they stay as small as
    its schema.
    """
    name = F.lower("column")

    def has(*words):
        match = F.lit(False)
        for word in words:
            match = match | name.contains(word)
        return match

    semantic = F.col("semantic_type")
    earlier = Window.partitionBy("table_name").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)

    def first(flag):
        return F.col(flag) & ~F.coalesce(F.bool_or(flag).over(earlier), F.lit(False))

    ranked = (
        typed_profile.withColumn("is_date", semantic == "date")
        .withColumn("first_date", first("is_date"))
        .withColumn(
            "by_name",
            F.when(F.col("first_date"), "date")
            .when(has("price", "arpu"), "price")
            .when(has("quantity", "volume", "qty"), "quantity")
            .when(has("revenue", "sales", "mrr"), "metric")
            .when(has("customer") & has("id"), "customer_id"),
        )
        .withColumn(
            "wants_customer",
            F.coalesce(F.col("by_name") == "customer_id", semantic == "id"),
        )
        .withColumn("first_customer", first("wants_customer"))
        .withColumn(
            "by_kind",
            F.when(F.col("by_name").isNotNull(), F.col("by_name"))
            .when((semantic == "id") & F.col("first_customer"), "customer_id")
            .when(has("region", "country"), "region")
            .when(has("product", "item"), "product")
            .when(has("channel", "source"), "channel")
            .when(semantic == "category", "segment"),
        )
        .withColumn("wants_metric", F.coalesce(F.col("by_kind") == "metric", semantic == "metric"))
        .withColumn("first_metric", first("wants_metric"))
        .withColumn(
            "role",
            F.coalesce("by_kind", F.when((semantic == "metric") & F.col("first_metric"), "metric")),
        )
    )
    return ranked.where("role is not null").select("table_name", "position", "column", "role")


def role_map(roles: DataFrame) -> dict[str, str]:
    """Roles as a dict; one entry per column of a table."""
    return {r["column"]: r["role"] for r in roles.orderBy("position").collect()}


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of the numeric columns; null and NaN do not count.

    Quartiles interpolate linearly and are exact: they are read off distributed
    value counts instead of a per-column value list.
    """
    columns = columns or numeric_columns(df)
    long = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
        )
    ).where(present(F.col("value")))
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = value_positions(
        long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")),
        ["column"],
        {"q25": 0.25, "q50": 0.5, "q75": 0.75},
    )
    return moments.join(quartiles, "column")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the finite values; the last bin is closed."""
    values = df.select(F.col(column).cast("double").alias("v")).where(present(F.col("v")) & (F.abs("v") < F.lit(float("inf"))))
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if bounds["lo"] is None:
        return values.select(
            F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.lit(0).cast("bigint").alias("n")
        )
    low, high = bounds["lo"], bounds["hi"]
    width = (high - low) / bins if high > low else 1.0 / bins
    low = low if high > low else low - 0.5
    index = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    return (
        values.groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
            "n",
        )
    )
