"""Batch reads under a declared schema, and partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, schema, fmt="parquet", **options) -> DataFrame:
    """Read `path` under `schema`: nothing is inferred, absent columns come as null."""
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def write_partitioned(df, path, by, mode="error", rows_per_file=5_000_000, fmt="parquet"):
    """Write `df` with one folder per value of `by`.

    Rows are brought together by `by`, so a value with few rows gets few files.
    The rebalance hint lets AQE cut a value with a large share of the rows into
    many tasks. `rows_per_file` bounds the size of any one file.
    """
    by = [by] if isinstance(by, str) else list(by)
    (
        df.hint("rebalance", *by)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by)
        .format(fmt)
        .save(path)
    )
