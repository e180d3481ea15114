"""Running a table of hypotheses through named tests.

A test is a function from a DataFrame and a list of hypotheses to one result
frame ``hypothesis_id, status, error, result``.  Hypotheses that use the same
test share its aggregations: they are stacked and grouped by hypothesis.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import type_class
from plumbline.operators import associate, compare, series

RESULT = "hypothesis_id string, test_name string, status string, error string, result map<string,double>"


@dataclass(frozen=True)
class Hypothesis:
    """One question: a test name and the columns it uses.

    ``options`` holds what a test needs besides, for example ``unit`` and
    ``period`` of a time series.
    """

    id: str
    test: str
    x: str
    y: str | None = None
    controls: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        named = [self.x, self.y, *self.controls, self.options.get("time"), *self.options.get("order", ())]
        return [c for c in named if c]


Test = Callable[[DataFrame, list[Hypothesis]], DataFrame]


def _as_result(frame: DataFrame, keys: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys]
    result = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    failed = F.col("status") == "error"
    empty = F.create_map().cast("map<string,double>")
    return frame.select("hypothesis_id", "status", "error", F.when(failed, empty).otherwise(result).alias("result"))


def _no_differences(frame: DataFrame) -> DataFrame:
    """No rows, with the columns that only ordered hypotheses fill."""
    return frame.limit(0).select("hypothesis_id", *[F.lit(None).cast("double").alias(c) for c in ("diff_pearson_r", "diff_pearson_p")])


def _stack(df: DataFrame, records: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*records)))


def _number(name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double")


def association_test(df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """Pearson and Spearman; with an ``order`` option (columns that order the rows) also of row-to-row differences.

    Hypotheses with the same order share their aggregations.
    """
    frames, key = [], ["hypothesis_id"]
    for order in sorted({tuple(h.options.get("order", ())) for h in hypotheses}):
        names = [f"o{i}" for i in range(len(order))]
        records = [
            F.struct(
                F.lit(h.id).alias("hypothesis_id"), _number(h.x).alias("x"), _number(h.y).alias("y"),
                *[F.col(f"`{c}`").alias(n) for c, n in zip(order, names, strict=True)],
            )
            for h in hypotheses
            if tuple(h.options.get("order", ())) == order
        ]
        long = _stack(df, records)
        if order:
            frame = associate.full_association(long, "x", "y", key, names)
        else:
            frame = associate.association(long, "x", "y", key).join(associate.spearman(long, "x", "y", key).drop("n"), key, "left")
        frames.append(frame)
    return _as_result(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*frames, _no_differences(frames[0])]),
        ["n", "pearson_r", "pearson_p", "pearson_ci_lower", "pearson_ci_upper", "spearman_r", "spearman_p", "diff_pearson_r", "diff_pearson_p"],
    )


def before_after_test(df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """x and y hold the values before and after."""
    records = []
    for h in hypotheses:
        for name, after in ((h.x, False), (h.y, True)):
            records.append(
                F.struct(F.lit(h.id).alias("hypothesis_id"), _number(name).alias("value"), F.lit(after).alias("after"))
            )
    result = compare.before_after(_stack(df, records), "value", F.col("after"), ["hypothesis_id"])
    return _as_result(
        result, ["statistic", "p", "effect_size", "ci_lower", "ci_upper", "n_a", "n_b", "mean_a", "mean_b"]
    )


def controlled_test(df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """Hypotheses with equally many controls share one aggregation."""
    frames = []
    for size in sorted({len(h.controls) for h in hypotheses}):
        alike = [h for h in hypotheses if len(h.controls) == size]
        names = [f"z{i}" for i in range(size)]
        long = _stack(
            df,
            [
                F.struct(
                    F.lit(h.id).alias("hypothesis_id"),
                    _number(h.x).alias("x"),
                    _number(h.y).alias("y"),
                    *[_number(c).alias(z) for c, z in zip(h.controls, names, strict=True)],
                )
                for h in alike
            ],
        )
        frames.append(associate.controlled_association(long, "x", "y", names, ["hypothesis_id"]))
    return _as_result(
        reduce(DataFrame.unionByName, frames),
        ["n", "raw_effect", "controlled_effect", "attenuation_ratio", "p_value", "ci_lower", "ci_upper", "vif_x", "r_squared"],
    )


def timeseries_test(df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """Sums of x per calendar unit of the ``time`` option.

    Series of equal unit, period and way of decomposition (option ``robust``) share their aggregations.
    """
    alike: dict[tuple, list[Hypothesis]] = {}
    for h in hypotheses:
        alike.setdefault((h.options.get("unit", "day"), h.options.get("period", 12), h.options.get("robust", True)), []).append(h)
    frames = []
    for (unit, period, robust), group in alike.items():
        records = [
            F.struct(
                F.lit(h.id).alias("hypothesis_id"),
                F.col(f"`{h.options['time']}`").cast("timestamp_ntz").alias("time"),
                _number(h.x).alias("x"),
            )
            for h in group
        ]
        points = series.bucketed_series(_stack(df, records), "time", unit, "x", ["hypothesis_id"])
        frames.append(series.analyze_timeseries(points, ["hypothesis_id"], "t", "value", period, robust))
    whole = reduce(DataFrame.unionByName, frames)
    return _as_result(
        whole.withColumn("is_stationary", F.col("is_stationary").cast("int")),
        ["n", "tau", "used_lag", "adf_p_value", "is_stationary", "seasonal_strength"],
    )


class TestRegistry:
    """Named tests; a failing one yields error rows and never stops the others."""

    __test__ = False  # not a pytest class

    def __init__(self):
        self.tests: dict[str, Test] = {}

    def register(self, name: str, test: Test) -> None:
        self.tests[name] = test

    @staticmethod
    def _complete(frame: DataFrame, name: str, group: list[Hypothesis]) -> DataFrame:
        """A hypothesis without a single usable row still gets a result."""
        asked = frame.sparkSession.createDataFrame([(h.id, name) for h in group], "hypothesis_id string, test_name string")
        empty = F.create_map().cast("map<string,double>")
        return asked.join(frame, "hypothesis_id", "left").select(
            "hypothesis_id",
            "test_name",
            F.coalesce("status", F.lit("error")).alias("status"),
            F.when(F.col("status").isNull(), "No usable rows").otherwise(F.col("error")).alias("error"),
            F.coalesce("result", empty).alias("result"),
        )

    def run(self, df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
        """One row per hypothesis: ``hypothesis_id, test_name, status, error, result``."""
        errors: list[tuple[str, str, str]] = []
        runnable: dict[str, list[Hypothesis]] = {}
        for h in hypotheses:
            missing = sorted(set(h.columns()) - set(df.columns))
            if h.test not in self.tests:
                errors.append((h.id, h.test, f"no test named {h.test}"))
            elif missing:
                errors.append((h.id, h.test, f"absent columns: {', '.join(missing)}"))
            elif texts := [c for c in (h.x, h.y) if c and type_class(df.schema[c].dataType) == "text"]:
                errors.append((h.id, h.test, f"not numeric: {', '.join(texts)}"))
            else:
                runnable.setdefault(h.test, []).append(h)
        frames = []
        for name, group in runnable.items():
            try:
                frame = self.tests[name](df, group).select("hypothesis_id", "status", "error", "result")
                frames.append(self._complete(frame, name, group))
            except (PySparkException, ValueError, KeyError) as error:
                errors += [(h.id, name, str(error)) for h in group]
        rows = [(i, name, "error", text, {}) for i, name, text in errors]
        frames.append(df.sparkSession.createDataFrame(rows, RESULT))
        return reduce(DataFrame.unionByName, frames)


def default_registry() -> TestRegistry:
    registry = TestRegistry()
    registry.register("association", association_test)
    registry.register("before_after", before_after_test)
    registry.register("controlled_association", controlled_test)
    registry.register("timeseries", timeseries_test)
    return registry
