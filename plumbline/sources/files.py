"""File scans: CSV, TSV and Parquet, chosen by suffix."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DELIMITERS = {".csv": ",", ".tsv": "\t"}


def load_file(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    view: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a table by file suffix.

    Without ``schema`` delimited text is read twice, once to infer types; pass
    the schema for large inputs.  Quotes inside quoted text are doubled.
    ``multiline`` allows line ends in quoted text; such a file is read by one
    task, so it stays off for large files.  ``view`` also registers the table
    for SQL.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    try:
        if suffix in _DELIMITERS:
            reader = spark.read.option("header", True).option("sep", _DELIMITERS[suffix])
            reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multiline)
            reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
            df = reader.csv(path)
        elif suffix == ".parquet":
            df = spark.read.parquet(path)
        else:
            raise ValueError(f"no reader for {suffix or path}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"nothing to read at {path}") from error
        raise
    if view:
        df.createOrReplaceTempView(view)
    return df
