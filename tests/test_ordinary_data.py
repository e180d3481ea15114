"""Values that real tables hold: NaN, decimals, quoted CSV, time zones, arms of one unit, text columns."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import associate, causal, compare, dispatch, explore, learning, ledger, profile
from plumbline.sources.files import load_file
from plumbline.sources.snapshot import table_hash

NAN = float("nan")


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1.0, 2.0, 1), (2.0, 1.0, 2), (3.0, 5.0, 3), (4.0, 4.0, 4), (NAN, 9.0, 5), (7.0, NAN, 6), (None, 1.0, 7)]
    return spark.createDataFrame(rows, "x double, y double, t int").withColumn("g", F.lit("a"))


def test_nan_is_a_missing_value(spark, pairs):
    clean = pairs.where("t <= 4")
    for test in (associate.association, associate.spearman):
        assert test(pairs, "x", "y", ["g"]).collect() == test(clean, "x", "y", ["g"]).collect()
    steps = associate.diff_association(pairs, "x", "y", ["g"], ["t"]).first()
    assert steps == associate.diff_association(clean, "x", "y", ["g"], ["t"]).first()
    cells = {(r.row, r.col): r.value for r in explore.correlation_matrix(pairs.select("x", "y")).collect()}
    assert cells["x", "y"] == pytest.approx(associate.association(clean, "x", "y", ["g"]).first().pearson_r)
    assert not any(r.leaks for r in learning.leakage_screen(pairs.select("x", "y"), "y").collect())
    found = causal.noise_scan(pairs, ["x"], "y").first()
    assert found.n == 4 and not found.naive_discovery and 0 < found.p <= 1
    wide = profile.describe_numeric(pairs, ["x"]).first()
    assert (wide["count"], wide["max"], wide.q50) == (5, 7.0, 3.0)
    bins = profile.histogram(pairs.where("t <= 5"), "x", 4).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.n) for r in bins] == [(1.0, 1.75, 1), (1.75, 2.5, 1), (2.5, 3.25, 1), (3.25, 4.0, 1)]


def test_constant_columns_have_no_p(spark):
    rows = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "x double, y double").withColumn("g", F.lit("a"))
    found = associate.association(rows, "x", "y", ["g"]).first()
    assert found.pearson_r is None and found.pearson_p is None


def test_decimals_are_ordered_as_numbers(spark):
    rows = [(Decimal(v),) for v in ("9.00", "10.00", "-3.00")]
    row = profile.profile_columns(spark.createDataFrame(rows, "d decimal(9,2)")).first()
    assert (row["min"], row["max"], row.distinct_count) == ("-3.00", "10.00", 3)


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text,note\n1,"say ""hi"", you",a\n2,"plain","b,c"\n')
    rows = load_file(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", you', "a"), (2, "plain", "b,c")]
    path.write_text('id,text\n1,"two\nlines"\n2,one\n')
    rows = load_file(spark, str(path), multiline=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "one")]


def test_hashes_do_not_depend_on_zone_or_map_order(spark):
    def made(s, m):
        return spark.range(3).selectExpr("id", "timestamp_micros(1700000000000000 + id) AS at", f"named_struct('m', map({s})) AS s", f"map({m}) AS m")

    def frame():
        return made("'a', id, 'b', bigint(2)", "'x', bigint(1), 'y', id")

    turned = made("'b', bigint(2), 'a', id", "'y', id, 'x', bigint(1)")
    first = table_hash(frame()), frame().select(ledger.content_hash(frame())).collect()
    assert table_hash(turned) == first[0]
    assert turned.select(ledger.content_hash(turned)).collect() == first[1]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert (table_hash(frame()), frame().select(ledger.content_hash(frame())).collect()) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_arm_of_one_unit_makes_the_error_unknown(spark):
    rows = [("s", t, v) for t, v in [(0, 1.0), (0, 2.0), (1, 4.0), (1, 6.0)]]
    known = causal.stratified_ate(spark.createDataFrame(rows, "g string, t int, v double"), "v", F.col("t") == 1, ["g"]).first()
    rows += [("u", 0, 1.0), ("u", 0, 3.0), ("u", 1, 5.0)]
    open_ = causal.stratified_ate(spark.createDataFrame(rows, "g string, t int, v double"), "v", F.col("t") == 1, ["g"]).first()
    assert known.att_se > 0 and open_.att_se is None and open_.att == pytest.approx(3.3333333)


def test_normality_is_judged_at_every_size(spark):
    skewed = spark.range(12_000).selectExpr("'g' AS g", "id % 2 = 0 AS b", "pow(id, 3) AS v")
    gate = compare.normality_gate(compare.two_sample_moments(skewed, "v", F.col("b"), ["g"])).first()
    assert gate.n_a == 6_000 and not gate.is_normal


def test_one_text_column_does_not_stop_other_hypotheses(spark):
    rows = spark.range(40).selectExpr("double(id) AS x", "double(id * id) AS y", "concat('t', id) AS name", "double(id % 7) AS z")
    asked = [
        dispatch.Hypothesis("ok", "association", "x", "y"),
        dispatch.Hypothesis("text", "association", "x", "name"),
        dispatch.Hypothesis("ok2", "controlled_association", "x", "y", ("z",)),
        dispatch.Hypothesis("text2", "controlled_association", "name", "y", ("z",)),
        dispatch.Hypothesis("text3", "before_after", "name", "y"),
    ]
    found = {r.hypothesis_id: r for r in dispatch.default_registry().run(rows, asked).collect()}
    assert {k: r.status for k, r in found.items()} == {"ok": "ok", "ok2": "ok", "text": "error", "text2": "error", "text3": "error"}
    assert "name" in found["text"].error and math.isfinite(found["ok"].result["pearson_p"])
