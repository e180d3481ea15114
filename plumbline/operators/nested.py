"""Nested results: leaves, look-up by path and comparison, on VARIANT values.

A result may be JSON text, a VARIANT, a map or a struct.  Everything happens in
the row: a walk unfolds one level of objects and arrays at a time, so no row is
exploded, shuffled or sent to Python.  Paths join keys and positions with dots.
Text that is no JSON gives no value; callers report such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels that a walk unfolds; what is nested deeper stays one leaf.
DEPTH = 8
NUMBER_KINDS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def as_variant(df: DataFrame, name: str) -> Column:
    """A column as VARIANT, whatever holds the result; null entries of a map count as absent."""
    data_type, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(data_type, T.VariantType):
        return col
    if isinstance(data_type, T.StringType):
        return F.try_parse_json(col)
    if isinstance(data_type, T.MapType):
        return F.to_variant_object(F.map_filter(col, lambda _, v: v.isNotNull()))
    return F.to_variant_object(col)


def malformed(df: DataFrame, name: str) -> Column:
    """There is a text, but it is no JSON."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False)
    return F.col(f"`{name}`").isNotNull() & F.try_parse_json(F.col(f"`{name}`")).isNull()


def kind(value: Column) -> Column:
    """SQL name of the type of a VARIANT: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, VOID or a number type."""
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return kind(value).rlike(NUMBER_KINDS)


def as_number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def leaves(value: Column, depth: int = DEPTH) -> Column:
    """array<struct<path, value>>: all scalars, and empty containers, of a VARIANT; null without a value."""

    def below(entry: Column, key: Column) -> Column:
        return F.when(entry["path"] == "", key).otherwise(F.concat(entry["path"], F.lit("."), key)).alias("path")

    def unfold(entry: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(entry["value"], "$", "map<string,variant>"))
        items = F.try_variant_get(entry["value"], "$", "array<variant>")
        return (
            F.when(F.size(fields) > 0, F.transform(fields, lambda f: F.struct(below(entry, f["key"]), f["value"].alias("value"))))
            .when(F.size(items) > 0, F.transform(items, lambda v, i: F.struct(below(entry, i.cast("string")), v.alias("value"))))
            .otherwise(F.array(F.struct(entry["path"].alias("path"), entry["value"].alias("value"))))
        )

    found = F.when(value.isNotNull(), F.array(F.struct(F.lit("").alias("path"), value.alias("value"))))
    for _ in range(depth):
        found = F.flatten(F.transform(found, unfold))
    return found


def by_path(entries: Column) -> Column:
    """Leaves as a map; of leaves with one path (a key with a dot in it) the last counts."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["path"].alias("path"), i.alias("i"))))
    last = F.filter(placed, lambda e, i: ~F.coalesce(F.get(placed, i + 1)["path"] == e["path"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["path"], F.get(entries, e["i"])["value"])))


def numeric_leaves(value: Column, depth: int = DEPTH) -> Column:
    """All finite numbers of a VARIANT as a map from path to double."""
    numbers = F.transform(leaves(value, depth), lambda e: F.struct(e["path"].alias("path"), as_number(e["value"]).alias("value")))
    finite = F.filter(numbers, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf")))
    return by_path(finite)


def at_path(value: Column, path: Column) -> Column:
    """The VARIANT at a dotted path of letters, digits and ``_``: a key that holds the dots itself, else one key a level."""
    whole = F.concat(F.lit("$['"), path, F.lit("']"))
    each = F.concat(F.lit("$['"), F.regexp_replace(path, r"\.", "']['"), F.lit("']"))
    return F.coalesce(F.try_variant_get(value, whole, "variant"), F.try_variant_get(value, each, "variant"))


def as_said(value: Column) -> Column:
    """Scalars other than fractions as text: strings bare, whole numbers, True, False, None; containers as JSON."""
    name = kind(value)
    return (
        F.when(name == "VOID", "None")
        .when(name == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(name == "STRING", F.try_variant_get(value, "$", "string"))
        .when(name.rlike("^(OBJECT|ARRAY)"), F.to_json(value))
        .when(name.rlike("INT$"), F.try_variant_get(value, "$", "string"))
    )


def nested_diff(expected: DataFrame, actual: DataFrame, same, keys: tuple[str, ...] = ("run_id", "id"), result: str = "result") -> DataFrame:
    """Differences of nested results by path: ``key, expected, actual`` (as JSON) and ``reason``.

    ``same(a, b)`` compares two doubles; other leaves must be equal.  A row whose
    text is no JSON on a side gives one row without a key.
    """
    left, right = (
        side.select(*keys, as_variant(side, result).alias(f"{mark}_value"), malformed(side, result).alias(f"{mark}_bad"))
        for side, mark in ((expected, "e"), (actual, "a"))
    )
    none = F.array().cast("array<struct<path:string,value:variant>>")
    both = left.join(right, list(keys), "full_outer").select(
        *keys,
        F.when(F.col("e_bad"), "malformed_expected").when(F.col("a_bad"), "malformed_actual").alias("bad"),
        *[F.coalesce(leaves(F.col(f"{m}_value")), none).alias(m) for m in "ea"],
    )
    both = both.select(*keys, "bad", *[by_path(F.col(m)).alias(m) for m in "ea"])
    paths = F.array_union(F.map_keys("e"), F.map_keys("a"))

    def entry(path: Column) -> Column:
        x, y = F.col("e")[path], F.col("a")[path]
        numbers = is_number(x) & is_number(y)
        equal = F.when(numbers, same(as_number(x), as_number(y))).otherwise((kind(x) == kind(y)) & (F.to_json(x) == F.to_json(y)))
        # The three reasons.
        reason = F.when(~F.map_contains_key("e", path), "missing_in_expected").when(~F.map_contains_key("a", path), "missing_in_actual").when(~equal, "mismatch")
        return F.struct(path.alias("key"), F.to_json(x).alias("expected"), F.to_json(y).alias("actual"), reason.alias("reason"))

    absent = F.lit(None).cast("string")
    bad = F.array(F.struct(absent.alias("key"), absent.alias("expected"), absent.alias("actual"), F.col("bad").alias("reason")))
    differing = F.filter(F.transform(paths, entry), lambda d: d["reason"].isNotNull())
    return both.select(*keys, F.inline(F.when(F.col("bad").isNotNull(), bad).otherwise(differing)))
