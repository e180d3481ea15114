"""Queries for sources, snapshots, profiles and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.plans.tables import CUSTOMER_SPEND_SQL, customer_spend, table
from plumbline.session import scratch_path
from plumbline.sources.artifacts import bounded_query as run_bounded
from plumbline.sources.files import load_file
from plumbline.sources.snapshot import create_snapshot, load_snapshot
from plumbline.sources.snapshot import table_fingerprint as fingerprint


def scan_csv(spark, sf_dir):
    path = f"{scratch_path(spark, 'orders')}.csv"
    source = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    source.write.option("header", True).csv(path)
    return load_file(spark, path).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


def scan_tsv(spark, sf_dir):
    path = f"{scratch_path(spark, 'customer')}.tsv"
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return load_file(spark, path).select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


def scan_parquet(spark, sf_dir):
    return load_file(spark, f"{sf_dir}/lineitem.parquet")


def scan_pushdown(spark, sf_dir):
    lines = load_file(spark, f"{sf_dir}/lineitem.parquet")
    return lines.where("l_shipdate >= timestamp_ntz'1996-01-01 00:00:00' and l_discount >= 0.05").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount"
    )


def table_fingerprint(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "orders")).select(F.lit("orders").alias("table_name"), "row_count", "data_hash")


def snapshot_roundtrip(spark, sf_dir):
    base = scratch_path(spark, "snapshots")
    digest = create_snapshot(
        {"customer": table(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation")}, base
    )
    frames = load_snapshot(spark, base, digest)
    return frames["customer"].join(frames["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name"
    )


_BOUNDED = """
SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice
FROM {orders} ORDER BY o_totalprice DESC, o_orderkey
"""


def bounded_query(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("bounded_orders")
    path = scratch_path(spark, "artifact")
    record = run_bounded(spark, _BOUNDED.format(orders="bounded_orders"), path).first()
    if record.status != "ok":
        raise RuntimeError(record.error)
    return spark.read.parquet(record.artifact_path)


def profile_columns(spark, sf_dir):
    result = profile.profile_columns(customer_spend(spark, sf_dir), "customer_spend")
    return result.select(
        "table_name", "position", "column", "type", F.round("null_rate", 6).alias("null_rate"), "distinct_count",
        "min", "max", "row_count",
    )


def profile_samples(spark, sf_dir):
    return profile.profile_samples(table(spark, sf_dir, "documents"))


def semantic_types(spark, sf_dir):
    typed = profile.semantic_types(profile.profile_columns(customer_spend(spark, sf_dir), "customer_spend"))
    return typed.select("position", "column", "type", "distinct_count", "semantic_type")


def infer_roles(spark, sf_dir):
    typed = profile.semantic_types(profile.profile_columns(customer_spend(spark, sf_dir), "customer_spend"))
    return profile.infer_roles(typed)


def describe_numeric(spark, sf_dir):
    result = profile.describe_numeric(table(spark, sf_dir, "lineitem"))
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")]
    return result.select("column", "count", *rounded)


def histogram(spark, sf_dir):
    result = profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 40)
    return result.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        scan_csv, scan_tsv, scan_parquet, scan_pushdown, table_fingerprint, snapshot_roundtrip, bounded_query,
        profile_columns, profile_samples, semantic_types, infer_roles, describe_numeric, histogram,
    )
}

_ORDER_FIELDS = [
    "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
    "CAST(o_totalprice AS VARCHAR)", "CAST(o_orderdate AS VARCHAR)", "o_orderpriority",
]
_ORDER_ROW = " || '|' || ".join(f"COALESCE(length({t}) || ':' || {t}, '~')" for t in _ORDER_FIELDS)
_ORDER_SUMS = " || '|' || ".join(
    f"CAST(SUM(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT)) AS VARCHAR)" for i in range(12)
)

_PROFILE = [
    ("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
    ("c_mktsegment", "text"), ("urgent_revenue", "numeric"), ("last_order", "date"), ("urgent_qty", "numeric"),
]


def _profile_sql() -> str:
    parts = [
        f"""SELECT 'customer_spend' AS table_name, {i} AS position, '{c}' AS "column", '{t}' AS type,
        (COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) AS null_rate, COUNT(DISTINCT {c}) AS distinct_count,
        CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max, COUNT(*) AS row_count FROM t"""
        for i, (c, t) in enumerate(_PROFILE)
    ]
    return f"WITH t AS ({CUSTOMER_SPEND_SQL}), p AS ({' UNION ALL '.join(parts)})"


_SEMANTIC = """CASE WHEN type = 'date' THEN 'date'
  WHEN type = 'numeric' THEN CASE WHEN distinct_count <= 2 THEN 'boolean' WHEN "column" LIKE '%id' THEN 'id' ELSE 'metric' END
  WHEN distinct_count < 100 OR distinct_count::DOUBLE / row_count < 0.05 THEN 'category'
  WHEN "column" LIKE '%id' THEN 'id' ELSE 'text' END"""


def _samples_sql() -> str:
    cols = {"doc_id": "CAST(doc_id AS VARCHAR)", "text": "text", "lang": "lang", "source": "source", "n_chars": "CAST(n_chars AS VARCHAR)"}
    long = " UNION ".join(f"""SELECT '{c}' AS "column", {e} AS value FROM documents""" for c, e in cols.items())
    return f"""WITH long AS ({long}), r AS (
      SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank
      FROM long WHERE value IS NOT NULL)
    SELECT "column", CAST(rank AS INTEGER) AS rank, CASE WHEN length(trim(value)) > 40
      THEN substr(trim(value), 1, 37) || '...' ELSE trim(value) END AS sample FROM r WHERE rank <= 5"""


_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _describe_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(stddev_samp({c}), 4) AS std,
        ROUND(MIN({c}), 4) AS min, ROUND(MAX({c}), 4) AS max, ROUND(quantile_cont({c}, 0.25), 4) AS q25,
        ROUND(quantile_cont({c}, 0.5), 4) AS q50, ROUND(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"""
        for c in _LINE_NUMBERS
    )


ORACLE = {
    "scan_csv": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
    "scan_tsv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_pushdown": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_discount >= 0.05""",
    "table_fingerprint": f"""WITH r AS (SELECT sha256({_ORDER_ROW}) AS h FROM orders)
        SELECT 'orders' AS table_name, COUNT(*) AS row_count,
        sha256(CAST(COUNT(*) AS VARCHAR) || '|' || {_ORDER_SUMS}) AS data_hash FROM r""",
    "snapshot_roundtrip": """SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "bounded_query": _BOUNDED.format(orders="orders"),
    "profile_columns": _profile_sql()
    + """ SELECT table_name, position, "column", type, ROUND(null_rate, 6) AS null_rate, distinct_count, min, max, row_count FROM p""",
    "profile_samples": _samples_sql(),
    "semantic_types": _profile_sql()
    + f""" SELECT position, "column", type, distinct_count, {_SEMANTIC} AS semantic_type FROM p""",
    "infer_roles": _profile_sql()
    + f""", s AS (SELECT *, {_SEMANTIC} AS semantic FROM p)
      SELECT table_name, position, "column",
        CASE WHEN semantic = 'date' THEN 'date' WHEN "column" LIKE '%qty%' THEN 'quantity'
             WHEN "column" LIKE '%revenue%' THEN 'metric' WHEN semantic = 'category' THEN 'segment'
             WHEN semantic = 'metric' THEN 'metric' END AS role
      FROM s WHERE semantic IN ('date', 'category') OR "column" LIKE '%qty%' OR "column" LIKE '%revenue%'
        OR position = (SELECT MIN(position) FROM s WHERE semantic = 'metric')""",
    "describe_numeric": _describe_sql(),
    "histogram": """WITH b AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders),
      w AS (SELECT lo, (hi - lo) / 40 AS width FROM b),
      x AS (SELECT CAST(LEAST(FLOOR((o_totalprice - lo) / width), 39) AS INTEGER) AS bin, lo, width FROM orders, w)
      SELECT bin, ROUND(MIN(lo) + bin * MIN(width), 6) AS lower, ROUND(MIN(lo) + (bin + 1) * MIN(width), 6) AS upper,
        COUNT(*) AS n FROM x GROUP BY bin""",
}
