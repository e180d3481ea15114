"""Bounded query results and evidence export."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 200

_IS_SELECT = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
_RECORD = (
    "kind string, code string, status string, error string, artifact_path string, "
    "num_rows bigint, truncated boolean, preview array<string>"
)


def bounded_query(
    spark: SparkSession, query: str, artifact_path: str, cap: int | None = None, preview_rows: int = PREVIEW_ROWS
) -> DataFrame:
    """Run one SELECT over the registered views and keep its result as Parquet.

    With a ``cap`` the result is cut at that many rows and the record says so
    in ``truncated``; give the query an ORDER BY so that the cut is repeatable.
    The returned record holds the row count and the first rows as JSON; a
    failing query becomes a record with status error.
    """
    try:
        if not _IS_SELECT.match(query):
            raise ValueError("only SELECT statements are allowed")
        result = spark.sql(query.rstrip().rstrip(";"))
        kept = result if cap is None else result.limit(cap)
        kept.write.mode("overwrite").parquet(artifact_path)
        stored = spark.read.parquet(artifact_path)
        rows = stored.count()
        truncated = cap is not None and rows == cap and result.limit(cap + 1).count() > cap
        preview = [row[0] for row in stored.limit(preview_rows).selectExpr("to_json(struct(*))").collect()]
        record = ("sql", query, "ok", None, artifact_path, rows, truncated, preview)
    except (PySparkException, ValueError) as error:
        record = ("sql", query, "error", str(error), None, None, None, None)
    return spark.createDataFrame([record], _RECORD)


def export_evidence(evidence: DataFrame, path: str, run_id: str | None = None) -> None:
    """Write evidence as JSON lines, one run or all of them."""
    chosen = evidence if run_id is None else evidence.where(evidence.run_id == run_id)
    chosen.write.mode("overwrite").json(path)
