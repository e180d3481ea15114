"""Comparing results of two evidence tables and filling text templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import nested

RELATIVE_TOLERANCE = 1e-9


def _same(a: Column, b: Column, rtol: float) -> Column:
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    close = F.abs(a - b) <= F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
        .when(infinite, a == b)
        .otherwise(close)
    )


def replay_diff(expected: DataFrame, actual: DataFrame, rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Key-wise differences of the results of equal evidence ids.

    The tables meet once per evidence row; the maps are compared in the row and
    only differing keys are expanded.
    """
    empty = F.create_map().cast("map<string,double>")
    left = expected.select("run_id", "id", F.col("result").alias("e"))
    right = actual.select("run_id", "id", F.col("result").alias("a"))
    both = left.join(right, ["run_id", "id"], "full_outer").select(
        "run_id", "id", F.coalesce("e", empty).alias("e"), F.coalesce("a", empty).alias("a")
    )
    keys = F.array_union(F.map_keys("e"), F.map_keys("a"))

    def entry(key):
        x, y = F.col("e")[key], F.col("a")[key]
        # The three reasons.
        reason = (
            F.when(~F.map_contains_key("e", key), "missing_in_expected")
            .when(~F.map_contains_key("a", key), "missing_in_actual")
            .when(~_same(x, y, rtol), "mismatch")
        )
        return F.struct(key.alias("key"), x.alias("expected"), y.alias("actual"), reason.alias("reason"))

    differing = F.filter(F.transform(keys, entry), lambda d: d["reason"].isNotNull())
    return both.select("run_id", "id", F.inline(differing))


def nested_diff(expected: DataFrame, actual: DataFrame, rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Differences by path of nested results: JSON text, VARIANT, maps or structs."""
    return nested.nested_diff(expected, actual, lambda x, y: _same(x, y, rtol))


# Placeholder syntax and the formats it may use.
PLACEHOLDER = r"\{([a-zA-Z0-9_]+)\.([a-zA-Z0-9_.]+)(?::([^}]+))?\}"
ALLOWED_FORMATS = (".0f", ".1f", ".2f", ".3f", ".4f", ".1%", ".2%", ",.0f", ",.2f", "s")


@F.pandas_udf(T.StringType())
def _formatted(value: pd.Series, spec: pd.Series) -> pd.Series:
    """Numbers by Python's format rules; null where there is none."""
    out = []
    for number, rule in zip(value, spec, strict=True):
        if number is None or pd.isna(number):
            out.append(None)
        elif rule in (None, "", "s"):
            out.append(str(int(number)) if float(number).is_integer() else str(float(number)))
        else:
            out.append(format(float(number), rule))
    return pd.Series(out, dtype=object)


def resolve_templates(templates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Fill ``{ev_0001.result.path:.1f}`` placeholders from the evidence of a run.

    ``templates`` has ``run_id, template_id, text``.  Results and parameters may
    be nested (JSON text, VARIANT, maps or structs).  A template with a
    placeholder that cannot be filled gets no text but the first error.
    """
    found = templates.select(
        "run_id", "template_id", F.posexplode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))).alias("pos", "raw")
    )
    parsed = found.select(
        "run_id",
        "template_id",
        "pos",
        F.regexp_extract("raw", PLACEHOLDER, 1).alias("id"),
        F.regexp_extract("raw", PLACEHOLDER, 2).alias("path"),
        F.regexp_extract("raw", PLACEHOLDER, 3).alias("spec"),
    )
    known = evidence.select(
        "run_id", "id", "status", nested.as_variant(evidence, "result").alias("result"), nested.as_variant(evidence, "params").alias("params"),
        nested.malformed(evidence, "result").alias("bad_result"), nested.malformed(evidence, "params").alias("bad_params"),
    )
    in_result, in_params = F.col("path").startswith("result."), F.col("path").startswith("params.")
    key = F.regexp_replace("path", r"^(result|params)\.", "")
    looked_up = parsed.join(known, ["run_id", "id"], "left").withColumn(
        "value", F.when(in_result, nested.at_path(F.col("result"), key)).when(in_params, nested.at_path(F.col("params"), key))
    )
    value = F.col("value")
    said = nested.as_said(value)
    truth = F.when(nested.kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    # Parameters are often kept as texts.
    spelled = F.when(in_params & (nested.kind(value) == "STRING"), said.try_cast("double"))
    number = F.coalesce(nested.as_number(value), truth, spelled)
    as_string = F.col("spec").isin("", "s")
    error = (
        F.when((F.col("spec") != "") & ~F.col("spec").isin(*ALLOWED_FORMATS), "bad_format")
        .when(F.col("status").isNull(), "unknown_id")
        .when(F.col("status") != "ok", "failed_evidence")
        .when(~(in_result | in_params), "bad_path_root")
        .when((in_result & F.col("bad_result")) | (in_params & F.col("bad_params")), "malformed_json")
        .when(value.isNull(), "unknown_path")
        .when(~as_string & number.isNull(), "not_a_number")
    )
    checked = looked_up.select("run_id", "template_id", "pos", "spec", error.alias("error"), said.alias("said"), number.alias("number"))
    fine = F.col("error").isNull()
    by_text = as_string & F.col("said").isNotNull()
    filled = checked.withColumn(
        "filled", F.when(fine & by_text, F.col("said")).otherwise(_formatted(F.when(fine & ~by_text, F.col("number")), F.col("spec")))
    )
    # At most one entry per placeholder of one text.
    gathered = filled.groupBy("run_id", "template_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "filled"))).alias("values"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
    )
    pieces = F.split("text", PLACEHOLDER, -1)
    values = F.coalesce(F.transform("values", lambda v: v["filled"]), F.array().cast("array<string>"))
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, values, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return templates.join(gathered, ["run_id", "template_id"], "left").select(
        "run_id",
        "template_id",
        F.when(F.col("error").isNull(), joined).alias("resolved"),
        F.when(F.col("error").isNull(), "ok").otherwise("unresolved").alias("status"),
        "error",
    )
