"""Running totals, lags and order statistics without one-task windows.

Rows are range-partitioned by (group, order columns) and the partition number
is kept as a chunk id.  A chunk is one task's share whatever the size of its
group, so windows run inside chunks; what crosses chunk borders (totals, last
values) is one small row per chunk and group.  The chunked table is written to
the checkpoint folder because range borders are sampled: it must not be
computed twice with different borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import join_groups
from plumbline.session import cut_lineage

CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds the chunk id; order values must be unique within a group."""
    keys = [F.col(c) for c in [*groups, *order]]
    return cut_lineage(df.repartitionByRange(*keys).withColumn(CHUNK, F.spark_partition_id()))


def _chunk_window(groups: list[str], order: list[str]):
    return Window.partitionBy(*groups, CHUNK).orderBy(*order)


def running_total(chunks: DataFrame, groups: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all earlier rows of the group."""
    across = Window.partitionBy(*groups).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.groupBy(*groups, CHUNK)
        .agg(F.sum(amount).alias("_t"))
        .select(*groups, CHUNK, F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"))
    )
    within = _chunk_window(groups, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_groups(chunks, offsets, [*groups, CHUNK])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("_base")
    )


def positions(df: DataFrame, groups: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Adds the number of earlier rows of the group; order values must be unique within it."""
    chunks = ordered_chunks(df.withColumn("_one", F.lit(1).cast("bigint")), groups, order)
    return running_total(chunks, groups, order, "_one", out).drop("_one", CHUNK)


def blocks_with_halo(numbered: DataFrame, rows: int, before: Column, after: Column, size: Column, out: str = "block") -> DataFrame:
    """Rows cut into blocks of ``rows`` by ``pos``, each with the ``before`` and ``after`` rows around it.

    ``size`` is the number of rows of the group.  A row that several blocks need
    is repeated; the own rows of a block are those with ``pos`` inside it.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - after) / rows)).cast("bigint")
    last = F.least(F.floor((size - 1) / rows), F.floor((F.col("pos") + before) / rows)).cast("bigint")
    return numbered.withColumn(out, F.explode(F.sequence(first, last)))


def suffix_min(chunks: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the least ``value`` from this row to the end of the group.

    Runs in descending order, since a frame that grows from the start is
    linear and one that ends at the last row is quadratic.
    """
    across = Window.partitionBy(*groups).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        chunks.groupBy(*groups, CHUNK)
        .agg(F.min(value).alias("_m"))
        .select(*groups, CHUNK, F.min("_m").over(across).alias("_later"))
    )
    falling = Window.partitionBy(*groups, CHUNK).orderBy(*[F.desc(c) for c in order])
    within = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        join_groups(chunks, later, [*groups, CHUNK])
        .withColumn(out, F.least(F.min(value).over(within), F.col("_later")))
        .drop("_later")
    )


def previous_values(chunks: DataFrame, groups: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev_<column>`` from the row before in the group."""
    last_by = F.struct(*order)
    across = Window.partitionBy(*groups).orderBy(CHUNK)
    heads = (
        chunks.groupBy(*groups, CHUNK)
        .agg(F.max_by(F.struct(*columns), last_by).alias("_tail"))
        .select(*groups, CHUNK, F.lag("_tail").over(across).alias("_head"))
    )
    within = _chunk_window(groups, order)
    joined = join_groups(chunks, heads, [*groups, CHUNK]).withColumn("_pos", F.row_number().over(within))
    for c in columns:
        joined = joined.withColumn(
            f"prev_{c}",
            F.when(F.col("_pos") == 1, F.col(f"_head.{c}")).otherwise(F.lag(c).over(within)),
        )
    return joined.drop("_head", "_pos")


def cumulative_counts(counts: DataFrame, groups: list[str], value: str = "value", cnt: str = "cnt") -> DataFrame:
    """Adds ``before``, the number of smaller observations, to distinct value counts."""
    chunks = ordered_chunks(counts, groups, [value])
    return running_total(chunks, groups, [value], cnt, "before")


def average_rank(before: str = "before", cnt: str = "cnt") -> Column:
    return F.col(before) + (F.col(cnt) + 1) / F.lit(2.0)


def order_statistics(cumulative: DataFrame, groups: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per group from cumulative counts."""
    totals = cumulative.groupBy(*groups).agg(F.sum("cnt").alias("_n"))
    rows = join_groups(cumulative, totals, groups)
    picks, outputs = [], []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(q)
        low = F.floor(at).cast("bigint")
        for side, position in (("lo", low), ("hi", F.least(low + 1, F.col("_n") - 1))):
            inside = (F.col("before") <= position) & (position < F.col("before") + F.col("cnt"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
        lo, hi, frac = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "f"))
        outputs.append((lo + (hi - lo) * frac).alias(name))
    return rows.groupBy(*groups).agg(*picks).select(*groups, *outputs)


def value_positions(counts: DataFrame, groups: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles per group from a (groups, value, cnt) table."""
    return order_statistics(cumulative_counts(counts, groups), groups, quantiles)
