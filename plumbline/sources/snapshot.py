"""Content-addressed table snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ledger import canonical

# A SHA-256 digest is cut into 12 chunks of 20 bits (the last 16 bits are
# unused), so that a bigint sum holds for 2**43 rows.
_CHUNKS = 12
_DIGITS = 5


def _field_text(df: DataFrame, field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return canonical(col, field.dataType)
    if isinstance(field.dataType, T.VariantType):
        return F.to_json(col)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(col)
    if isinstance(field.dataType, T.TimestampType):
        # an instant: its text would depend on the session's time zone
        return F.unix_micros(col).cast("string")
    # A double's text is its shortest exact form, so any changed bit shows.
    return col.cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row; fields carry their length, so no two rows collide by joining."""
    parts = []
    for field in df.schema.fields:
        text = _field_text(df, field)
        parts.append(
            F.when(F.col(f"`{field.name}`").isNull(), F.lit("~"))
            .otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))
        )
    return F.sha2(F.concat_ws("|", *parts), 256)


def schema_text(df: DataFrame) -> str:
    return "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent digest of a table's rows: ``row_count, data_hash``.

    Chunks of the row digests are summed over the table.  Sums do not depend
    on row order and count duplicates, and they are partial aggregates: a scan
    ships one row per task, never the row hashes.
    """
    rows = df.select(row_digest(df).alias("h"))
    chunks = [
        F.conv(F.substring("h", 1 + i * _DIGITS, _DIGITS), 16, 10).cast("bigint")
        for i in range(_CHUNKS)
    ]
    sums = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(chunks)],
    )
    joined = F.concat_ws("|", F.col("row_count"), *[F.col(f"s{i}") for i in range(_CHUNKS)])
    return sums.select(
        "row_count",
        F.when(F.col("row_count") == 0, F.lit("")).otherwise(F.sha2(joined, 256)).alias("data_hash"),
    )


def table_hash(df: DataFrame) -> str:
    data_hash = table_fingerprint(df).first()["data_hash"]
    return hashlib.sha256(f"{schema_text(df)}||{data_hash}".encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def create_snapshot(tables: dict[str, DataFrame], base_dir: str) -> str:
    """Write the tables below a folder named by their combined hash.

    A table already written completely is left alone; one without its success
    marker (a writer died) is written again.
    """
    combined = "|".join(f"{name}:{table_hash(tables[name])}" for name in sorted(tables))
    digest = hashlib.sha256(combined.encode()).hexdigest()
    for name, df in tables.items():
        target = f"{base_dir.rstrip('/')}/{digest}/{name}"
        if not _exists(df.sparkSession, f"{target}/_SUCCESS"):
            df.write.mode("overwrite").parquet(target)
    return digest


def load_snapshot(spark: SparkSession, base_dir: str, digest: str) -> dict[str, DataFrame]:
    """Register every table of a snapshot as a view."""
    folder = f"{base_dir.rstrip('/')}/{digest}"
    if not _exists(spark, folder):
        raise FileNotFoundError(f"no snapshot {digest} below {folder}")
    fs, hadoop_path = _file_system(spark, folder)
    frames = {}
    for status in fs.listStatus(hadoop_path):
        if status.isDirectory():
            name = status.getPath().getName()
            frames[name] = spark.read.parquet(f"{folder}/{name}")
            frames[name].createOrReplaceTempView(name)
    return frames
