"""Import of relational-database tables over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Partitioning:
    """Splits one table read into ``partitions`` range queries on ``column``."""

    column: str
    lower: int
    upper: int
    partitions: int


def reader_options(
    url: str,
    table: str,
    driver: str | None = None,
    partitioning: Partitioning | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """JDBC options for one table."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if driver:
        options["driver"] = driver
    if partitioning:
        options |= {
            "partitionColumn": partitioning.column,
            "lowerBound": str(partitioning.lower),
            "upperBound": str(partitioning.upper),
            "numPartitions": str(partitioning.partitions),
        }
    return options


def load_database(
    spark: SparkSession,
    url: str,
    tables: dict[str, Partitioning | None],
    driver: str | None = None,
) -> dict[str, DataFrame]:
    """Register each listed table as a view read in parallel from the database.

    Give a ``Partitioning`` for every large table; without one a table comes
    over a single connection.
    """
    frames = {}
    for table, partitioning in tables.items():
        options = reader_options(url, table, driver, partitioning)
        frame = spark.read.format("jdbc").options(**options).load()
        frame.createOrReplaceTempView(table.split(".")[-1])
        frames[table] = frame
    return frames
