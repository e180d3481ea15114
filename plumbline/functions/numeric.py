"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_up(col: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def present(col: Column) -> Column:
    """Neither null nor NaN."""
    return col.isNotNull() & ~F.isnan(col.cast("double"))


def money(col: Column) -> Column:
    """Two-decimal exact amount, so that sums do not depend on row order."""
    return col.cast("decimal(18,2)")


def type_class(data_type: T.DataType) -> str:
    """numeric, date, boolean or text."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "text"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) == "numeric"]


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on group keys where a null key is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text; nested values as JSON."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.col(f"`{name}`"))
    if isinstance(data_type, T.BinaryType):
        return F.hex(F.col(f"`{name}`"))
    return F.col(f"`{name}`").cast("string")
