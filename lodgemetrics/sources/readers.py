"""Sources and sinks: explicit schemas in, partitioned files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodgemetrics.schema import RAW_BOOKING


def read_bookings(spark: SparkSession, path: str, fmt: str = "csv",
                  schema: T.StructType = RAW_BOOKING) -> DataFrame:
    """Read raw bookings; CSV files need a header row and are never type-inferred."""
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("nullValue", "")
                .option("enforceSchema", False).csv(path))
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt in ("parquet", "orc"):
        return spark.read.schema(schema).format(fmt).load(path)
    raise ValueError(f"unsupported booking format: {fmt}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a fact or dimension; partition columns should be low-cardinality (year, month).

    Existing files are only replaced when ``mode`` says so, and then, if partitioned, only the partitions written.
    """
    writer = df.write.mode(mode).format(fmt).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line."""
    df.write.mode(mode).json(path)
