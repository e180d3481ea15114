import datetime as dt
import math

import numpy as np
import pytest

from plumbline.operators import explore, profile, quality

ROWS = [(dt.date(2024, 1, 1), 10.5, 1, "NA"), (dt.date(2024, 1, 2), None, 2, "EU"), (dt.date(2024, 1, 3), 7.0, 3, "NA")]
SCHEMA = "date date, revenue double, customer_id int, region string"


@pytest.mark.parametrize("exact", [True, False])
def test_profile_counts_and_types(spark, exact):
    typed = profile.semantic_types(profile.profile_columns(spark.createDataFrame(ROWS, SCHEMA), exact=exact))
    by_name = {r["column"]: r for r in typed.collect()}
    assert by_name["revenue"].null_rate == pytest.approx(1 / 3)
    assert [by_name[c].distinct_count for c in ("date", "revenue", "customer_id", "region")] == [3, 2, 3, 2]
    assert (by_name["date"].min, by_name["date"].max) == ("2024-01-01", "2024-01-03")
    assert {c: r.semantic_type for c, r in by_name.items()} == {
        "date": "date", "revenue": "boolean", "customer_id": "id", "region": "category",
    }


def test_profile_of_empty_and_nested_tables(spark):
    assert profile.profile_columns(spark.createDataFrame([], SCHEMA)).count() == 0
    nested = spark.createDataFrame([([1, 2], {"a": 1.0}), ([1, 2], {"a": 1.0})], "xs array<int>, m map<string,double>")
    rows = profile.profile_columns(nested).collect()
    assert [r.type for r in rows] == ["text", "text"] and [r.distinct_count for r in rows] == [1, 1]


def test_negative_zero_is_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert profile.profile_columns(df).first().distinct_count == 2


def test_samples_are_trimmed_and_ordered(spark):
    df = spark.createDataFrame([("b" * 50,), ("  a ",), ("c",), (None,), ("c",)], "t string")
    samples = [r.sample for r in profile.profile_samples(df).orderBy("rank").collect()]
    assert samples == ["a", "b" * 37 + "...", "c"]


def test_roles_follow_rule_order(spark):
    typed = spark.createDataFrame(
        [
            ("t", 0, "created", "date"), ("t", 1, "price_date", "date"), ("t", 2, "item_id", "id"), ("t", 3, "store_id", "id"),
            ("t", 4, "customer_id", "id"), ("t", 5, "qty", "metric"), ("t", 6, "score", "metric"), ("t", 7, "weight", "metric"),
            ("t", 8, "country", "category"), ("t", 9, "colour", "category"), ("t", 10, "note", "text"), ("t", 11, "product_id", "id"),
        ],
        "table_name string, position int, column string, semantic_type string",
    )
    assert profile.role_map(profile.infer_roles(typed)) == {
        "created": "date", "price_date": "price", "item_id": "customer_id", "customer_id": "customer_id", "qty": "quantity",
        "score": "metric", "country": "region", "colour": "segment", "product_id": "product",
    }


def test_named_metric_blocks_the_fallback(spark):
    typed = spark.createDataFrame(
        [("t", 0, "revenue", "metric"), ("t", 1, "score", "metric")],
        "table_name string, position int, column string, semantic_type string",
    )
    assert profile.role_map(profile.infer_roles(typed)) == {"revenue": "metric"}


def test_describe_with_one_hot_value(spark):
    values = [5.0] * 60 + [float(i) for i in range(41)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    row = profile.describe_numeric(df).first()
    assert (row["count"], row["min"], row["max"]) == (101, 0.0, 40.0)
    assert [row.q25, row.q50, row.q75] == [float(np.quantile(values, q)) for q in (0.25, 0.5, 0.75)]
    assert row["std"] == pytest.approx(np.std(values, ddof=1))


def test_histogram_closes_last_bin_and_keeps_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "x double")
    bins = {r.bin: r.n for r in profile.histogram(df, "x", 5).collect()}
    assert bins == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    constant = profile.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 5).collect()
    assert [r.n for r in constant] == [4]
    assert profile.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_null_check_severities(spark):
    rows = [(1.0 if i else None, float(i), dt.date(2024, 1, 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, d date")
    roles = {"a": "metric", "b": "price", "d": "date"}
    found = {r.column: (r.severity, r.value) for r in quality.check_nulls(df, roles).collect()}
    assert found == {"a": ("warning", 0.01), "b": ("info", 0.0), "d": ("info", 0.0)}
    blocking = quality.check_nulls(df, roles, max_null_rate=0.005).where("severity = 'blocking'")
    assert [r.column for r in blocking.collect()] == ["a"]
    assert quality.check_nulls(df, {"a": "segment"}).collect() == [("check_nulls", None, "info", None)]


def test_duplicates_negatives_and_report(spark):
    df = spark.createDataFrame([(1, -1.0, None)] * 40 + [(2, 3.0, "x")], "k int, m double, s string")
    roles = {"m": "metric", "s": "segment"}
    assert quality.check_duplicates(df).first().value == 39
    assert quality.check_negatives(df, roles).first().value == 40
    report = quality.quality_report(df, roles).collect()
    assert {r.check: r.check_severity for r in report} == {
        "check_nulls": "info", "check_duplicates": "warning", "check_negatives": "warning",
    }
    empty = df.limit(0)
    assert quality.check_duplicates(empty).first().severity == "info"
    assert quality.check_negatives(empty, roles).first().value == 0


def test_finite_check(spark):
    df = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 1.0), (4, None)], "k int, v double")
    assert sorted(quality.check_finite(df, "k", ["v"]).collect()) == [(1, "v", "nan"), (2, "v", "inf")]
    with pytest.raises(ValueError, match="missing"):
        quality.check_finite(df, "k", ["w"])
    with pytest.raises(ValueError, match="non-finite"):
        quality.require_plottable(df, "k", ["v"])
    with pytest.raises(ValueError, match="empty"):
        quality.require_plottable(df.limit(0), "k", ["v"])
    assert quality.require_plottable(df.where("k > 2"), "k", ["v"]).count() == 2


def test_small_fractions_are_not_rounded_away(spark):
    df = spark.createDataFrame([("a", 0.0012), ("a", 0.0013), ("b", 1e20)], "region string, revenue double")
    top = explore.top_segments(df, {"region": "region", "revenue": "metric"}).collect()
    assert {r.label: r.value for r in top} == {"a": pytest.approx(0.0025), "b": 1e20}


def test_correlation_handles_constants_and_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.5, 5.0, 2.0), (4.0, None, 5.0, 4.0)],
        "a double, b double, c double, d double",
    )
    cells = {(r.row, r.col): r.value for r in explore.correlation_matrix(df).collect()}
    assert len(cells) == 16 and cells["a", "c"] == 0.0 and cells["c", "c"] == 1.0
    assert cells["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert cells["b", "d"] == cells["d", "b"] == pytest.approx(1.0)
    assert explore.correlation_matrix(df.select("a")).count() == 0
    assert explore.heatmap_cells(explore.correlation_matrix(df.select("a", "b"))).count() == 4


def test_top_segments_drops_nulls_and_limits(spark):
    rows = [(f"r{i % 8}", None if i % 3 else "x", float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "region string, channel string, revenue double")
    roles = {"region": "region", "channel": "channel", "revenue": "metric"}
    top = explore.top_segments(df, roles, 5).collect()
    regions = [(r.label, r.value) for r in sorted(top, key=lambda r: r.rank) if r.segment == "region"]
    sums = {}
    for region, _, value in rows:
        sums[region] = sums.get(region, 0) + value
    assert regions == sorted(sums.items(), key=lambda p: -p[1])[:5]
    assert [r.label for r in top if r.segment == "channel"] == ["x"]
    assert explore.top_segments(df, {"region": "region"}).count() == 0


def test_decomposition_reconciles_and_needs_roles(spark):
    rows = [("a", 1, 10.0), ("a", 1, 20.0), ("b", 1, 30.0), ("a", 2, 50.0), ("c", 2, 25.0), ("d", 2, 25.0)]
    df = spark.createDataFrame(rows, "customer string, period int, revenue double")
    roles = {"customer": "customer_id", "revenue": "metric"}
    r = explore.revenue_decomposition(df, roles, "period = 1", "period = 2").first()
    assert (r.customers_a, r.customers_b, r.delta_revenue, r.reconciles) == (2, 3, 40.0, True)
    assert r.customer_effect + r.arpu_effect + r.interaction_effect == pytest.approx(40.0)
    none = explore.revenue_decomposition(df, roles, "period = 1", "period = 9").first()
    assert (none.customers_b, none.arpu_b, none.delta_revenue) == (0, 0.0, -60.0)
    with pytest.raises(explore.DecompositionError):
        explore.revenue_decomposition(df, {"revenue": "metric"}, "period = 1", "period = 2")


def test_waterfall_ends_at_total(spark):
    steps = spark.createDataFrame([(1, 1, "up", 120.0), (1, 2, "down", -30.0), (1, 3, "rest", 5.0)], "g int, o int, l string, v double")
    bars = sorted(explore.waterfall(steps, ["g"], "o", "l", "v").collect(), key=lambda r: r.o)
    assert [(b.start, b.end) for b in bars] == [(0.0, 120.0), (120.0, 90.0), (90.0, 95.0)]


def test_correlations_of_a_wide_table(spark):
    rng = np.random.default_rng(5)
    width, n = 300, 60
    x = rng.normal(size=(n, width)) * 10.0 ** rng.integers(-3, 4, width) + 1e6
    x[:, 7] = 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"n.{i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(row)) for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(40)
    cells = {(r.row, r.col): r.value for r in explore.correlation_matrix(df).collect()}
    assert len(cells) == width * width
    for a, b in [(0, 1), (5, 250), (299, 64), (63, 64), (130, 130), (7, 8)]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        expected = 1.0 if a == b else 0.0 if 7 in (a, b) else np.corrcoef(x[both, a], x[both, b])[0, 1]
        assert cells[names[a], names[b]] == cells[names[b], names[a]] == pytest.approx(expected, abs=1e-7)
    endless = spark.createDataFrame([(1.0, 2.0, 1.0), (float("inf"), 3.0, 2.0), (2.0, None, 4.0)], "a double, b double, c double")
    cells = {(r.row, r.col): r.value for r in explore.correlation_matrix(endless).collect()}
    assert np.isnan(cells["a", "b"]) and np.isnan(cells["c", "a"]) and cells["b", "c"] == pytest.approx(1.0)
    empty = {(r.row, r.col): r.value for r in explore.correlation_matrix(endless.limit(0)).collect()}
    assert empty["a", "a"] == 1.0 and empty["a", "b"] == 0.0


def test_samples_and_counts_of_long_texts(spark):
    rows = [(f"{i % 300:03d}" + "x" * 5_000, i % 7 if i % 5 else None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "t string, k int").repartition(9)
    found = {(r.column, r["rank"]): r.sample for r in profile.profile_samples(df).collect()}
    assert len(found) == 10 and found["t", 1].startswith("000xxx") and found["t", 5].startswith("004") and found["k", 5] == "4"
    assert {r.column: r.distinct_count for r in profile.profile_columns(df).collect()} == {"t": 300, "k": 7}
