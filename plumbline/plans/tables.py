"""Test-table access and role maps shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numeric import money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment, nation and balance."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


SALES_ROLES = {
    "o_orderdate": "date",
    "o_custkey": "customer_id",
    "o_totalprice": "metric",
    "c_mktsegment": "segment",
    "c_nationkey": "region",
    "o_orderpriority": "channel",
}

SALES_SQL = "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"


def customer_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with their urgent orders over all orders; null for those without any."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.when(urgent, money(F.col("o_totalprice")))).cast("double").alias("urgent_revenue"),
            F.max("o_orderdate").alias("last_order"),
            F.sum(F.when(urgent, 1)).alias("urgent_qty"),
        )
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(spend, customers.c_custkey == spend.o_custkey, "left").drop("o_custkey")


CUSTOMER_SPEND_ROLES = {
    "c_custkey": "customer_id",
    "c_acctbal": "metric",
    "c_mktsegment": "segment",
    "urgent_revenue": "metric",
    "last_order": "date",
    "urgent_qty": "quantity",
}

CUSTOMER_SPEND_SQL = """
SELECT c.*, s.urgent_revenue, s.last_order, s.urgent_qty
FROM customer c LEFT JOIN (
  SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS urgent_revenue,
         MAX(o_orderdate) AS last_order, nullif(COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS urgent_qty
  FROM orders GROUP BY o_custkey) s
ON c.c_custkey = s.o_custkey
"""
