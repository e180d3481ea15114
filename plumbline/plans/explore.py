"""Queries for quality checks, exploratory analyses and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numeric import money
from plumbline.operators import explore, quality
from plumbline.plans.tables import (
    CUSTOMER_SPEND_ROLES,
    CUSTOMER_SPEND_SQL,
    SALES_ROLES,
    SALES_SQL,
    customer_spend,
    sales,
    table,
)

_YEAR_96 = "o_orderdate >= timestamp_ntz'1996-01-01 00:00:00' and o_orderdate < timestamp_ntz'1997-01-01 00:00:00'"
_YEAR_97 = "o_orderdate >= timestamp_ntz'1997-01-01 00:00:00' and o_orderdate < timestamp_ntz'1998-01-01 00:00:00'"
_CORRELATED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def check_nulls(spark, sf_dir):
    return _rounded(quality.check_nulls(customer_spend(spark, sf_dir), CUSTOMER_SPEND_ROLES), 6, "value")


def check_duplicates(spark, sf_dir):
    return quality.check_duplicates(table(spark, sf_dir, "lineitem"))


def check_negatives(spark, sf_dir):
    return quality.check_negatives(customer_spend(spark, sf_dir), CUSTOMER_SPEND_ROLES)


def quality_report(spark, sf_dir):
    return _rounded(quality.quality_report(customer_spend(spark, sf_dir), CUSTOMER_SPEND_ROLES), 6, "value")


def check_finite(spark, sf_dir):
    balance = F.col("c_acctbal")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(balance < 0, F.lit(float("nan"))).otherwise(F.sqrt(F.abs(balance))).alias("root_balance"),
        F.when(balance > 9000, F.lit(float("inf"))).when(balance < -900, F.lit(float("-inf"))).otherwise(balance).alias("gap"),
    )
    return quality.check_finite(customers, "c_custkey", ["root_balance", "gap"])


def correlation_matrix(spark, sf_dir):
    return _rounded(explore.correlation_matrix(table(spark, sf_dir, "lineitem").select(*_CORRELATED)), 6, "value")


def heatmap_cells(spark, sf_dir):
    return explore.heatmap_cells(
        explore.correlation_matrix(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"))
    )


def top_segments(spark, sf_dir):
    return _rounded(explore.top_segments(sales(spark, sf_dir), SALES_ROLES, 5), 2, "value")


def revenue_decomposition(spark, sf_dir):
    result = explore.revenue_decomposition(sales(spark, sf_dir), SALES_ROLES, _YEAR_96, _YEAR_97, ["c_mktsegment"])
    return _rounded(
        result, 2, "revenue_a", "revenue_b", "arpu_a", "arpu_b", "delta_revenue", "customer_effect", "arpu_effect",
        "interaction_effect",
    )


def waterfall(spark, sf_dir):
    split = explore.revenue_decomposition(sales(spark, sf_dir), SALES_ROLES, _YEAR_96, _YEAR_97, ["c_mktsegment"])
    steps = explore.decomposition_steps(split, ["c_mktsegment"])
    bars = explore.waterfall(steps, ["c_mktsegment"], "step", "name", "amount")
    return _rounded(bars, 2, "start", "end", "value")


def bar_series(spark, sf_dir):
    return explore.bar_series(
        table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.sum(money(F.col("l_extendedprice")))
    )


def line_series(spark, sf_dir):
    return explore.line_series(
        table(spark, sf_dir, "orders"), "o_orderdate", "month", F.sum(money(F.col("o_totalprice")))
    )


def scatter_points(spark, sf_dir):
    return explore.scatter_points(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_type")


QUERIES = {
    f.__name__: f
    for f in (
        check_nulls, check_duplicates, check_negatives, quality_report, check_finite, correlation_matrix, heatmap_cells,
        top_segments, revenue_decomposition, waterfall, bar_series, line_series, scatter_points,
    )
}


def _null_sql(columns):
    parts = [f"SELECT '{c}' AS c, (COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) AS v FROM t" for c in columns]
    return f"""SELECT 'check_nulls' AS "check", c AS "column",
      CASE WHEN v > 0.02 THEN 'blocking' WHEN v > 0 THEN 'warning' ELSE 'info' END AS severity, ROUND(v, 6) AS value
      FROM ({" UNION ALL ".join(parts)})"""


def _negative_sql(columns):
    parts = [f"SELECT '{c}' AS c, COUNT(*) FILTER (WHERE {c} < 0)::DOUBLE AS v FROM t" for c in columns]
    return f"""SELECT 'check_negatives' AS "check", c AS "column",
      CASE WHEN v > 0 THEN 'warning' ELSE 'info' END AS severity, v AS value FROM ({" UNION ALL ".join(parts)})"""


def _duplicate_sql(source):
    return f"""SELECT 'check_duplicates' AS "check", CAST(NULL AS VARCHAR) AS "column",
      CASE WHEN a.n > b.n THEN 'warning' ELSE 'info' END AS severity, (a.n - b.n)::DOUBLE AS value
      FROM (SELECT COUNT(*) AS n FROM {source}) a, (SELECT COUNT(*) AS n FROM (SELECT DISTINCT * FROM {source})) b"""


_NULL_COLUMNS = ["c_acctbal", "urgent_revenue", "last_order", "urgent_qty"]
_NEGATIVE_COLUMNS = ["c_acctbal", "urgent_revenue", "urgent_qty"]
_T = f"WITH t AS ({CUSTOMER_SPEND_SQL}) "


def _corr_sql(source, columns, digits):
    parts = []
    for a in columns:
        for b in columns:
            value = "1.0" if a == b else f"COALESCE(corr({a}, {b}), 0.0)"
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, ROUND({value}::DOUBLE, {digits}) AS value FROM {source}")
    return " UNION ALL ".join(p if "corr(" in p else p.replace(f" FROM {source}", "") for p in parts)


def _segments_sql():
    cells = {"c_mktsegment": "c_mktsegment", "c_nationkey": "CAST(c_nationkey AS VARCHAR)", "o_orderpriority": "o_orderpriority"}
    sums = " UNION ALL ".join(
        f"SELECT '{k}' AS segment, {e} AS label, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM s GROUP BY {e}"
        for k, e in cells.items()
    )
    return f"""WITH s AS ({SALES_SQL}), g AS ({sums}), r AS (
      SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total DESC, label) AS rank FROM g)
      SELECT segment, label, CAST(total AS DOUBLE) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


_DECOMPOSITION = f"""WITH s AS ({SALES_SQL}), f AS (
  SELECT c_mktsegment, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, year(o_orderdate) AS y FROM s),
g AS (SELECT c_mktsegment,
  COUNT(DISTINCT CASE WHEN y = 1996 THEN o_custkey END) AS customers_a,
  COUNT(DISTINCT CASE WHEN y = 1997 THEN o_custkey END) AS customers_b,
  CAST(COALESCE(SUM(CASE WHEN y = 1996 THEN price END), 0) AS DOUBLE) AS revenue_a,
  CAST(COALESCE(SUM(CASE WHEN y = 1997 THEN price END), 0) AS DOUBLE) AS revenue_b
  FROM f WHERE y IN (1996, 1997) GROUP BY c_mktsegment),
h AS (SELECT *, CASE WHEN customers_a = 0 THEN 0.0 ELSE revenue_a / customers_a END AS arpu_a,
  CASE WHEN customers_b = 0 THEN 0.0 ELSE revenue_b / customers_b END AS arpu_b FROM g),
d AS (SELECT *, revenue_b - revenue_a AS delta_revenue, (customers_b - customers_a) * arpu_a AS customer_effect,
  (arpu_b - arpu_a) * customers_a AS arpu_effect, (customers_b - customers_a) * (arpu_b - arpu_a) AS interaction_effect FROM h)"""

ORACLE = {
    "check_nulls": _T + _null_sql(_NULL_COLUMNS),
    "check_duplicates": _duplicate_sql("lineitem"),
    "check_negatives": _T + _negative_sql(_NEGATIVE_COLUMNS),
    "quality_report": _T
    + f""", r AS ({_null_sql(_NULL_COLUMNS)} UNION ALL {_duplicate_sql("t")} UNION ALL {_negative_sql(_NEGATIVE_COLUMNS)}),
      w AS (SELECT "check", MAX(CASE severity WHEN 'blocking' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r FROM r GROUP BY "check")
      SELECT r."check", r."column", r.severity, r.value,
        CASE w.r WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'info' END AS check_severity
      FROM r JOIN w ON r."check" = w."check" """,
    "check_finite": """SELECT c_custkey, 'root_balance' AS "column", 'nan' AS reason FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_custkey, 'gap', CASE WHEN c_acctbal > 9000 THEN 'inf' ELSE '-inf' END FROM customer
      WHERE c_acctbal > 9000 OR c_acctbal < -900""",
    "correlation_matrix": _corr_sql("lineitem", _CORRELATED, 6),
    "heatmap_cells": _corr_sql("part", ["p_partkey", "p_size", "p_retailprice"], 4),
    "top_segments": _segments_sql(),
    "revenue_decomposition": _DECOMPOSITION
    + """SELECT c_mktsegment, customers_a, customers_b, ROUND(revenue_a, 2) AS revenue_a, ROUND(revenue_b, 2) AS revenue_b,
      ROUND(arpu_a, 2) AS arpu_a, ROUND(arpu_b, 2) AS arpu_b, ROUND(delta_revenue, 2) AS delta_revenue,
      ROUND(customer_effect, 2) AS customer_effect, ROUND(arpu_effect, 2) AS arpu_effect,
      ROUND(interaction_effect, 2) AS interaction_effect,
      abs(customer_effect + arpu_effect + interaction_effect - delta_revenue) <= 1e-5 AS reconciles FROM d""",
    "waterfall": _DECOMPOSITION
    + """, st AS (SELECT c_mktsegment, 1 AS step, 'customer_effect' AS label, customer_effect AS value FROM d
      UNION ALL SELECT c_mktsegment, 2, 'arpu_effect', arpu_effect FROM d
      UNION ALL SELECT c_mktsegment, 3, 'interaction_effect', interaction_effect FROM d),
      w AS (SELECT *, SUM(value) OVER (PARTITION BY c_mktsegment ORDER BY step) AS e FROM st)
      SELECT c_mktsegment, step, label, ROUND(e - value, 2) AS start, ROUND(e, 2) AS "end", ROUND(value, 2) AS value FROM w""",
    "bar_series": """SELECT CAST(l_linenumber AS VARCHAR) AS label,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY l_linenumber""",
    "line_series": """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS x,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1""",
    "scatter_points": "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_type AS color FROM part",
}
