"""Stacking, set operations and stable samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.copies import numbered_copies
from millrace.functions.text import stable_bucket


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _counted(a, b):
    """Distinct rows with their number of copies on each side: one shuffle, pre-aggregated."""
    marked = a.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).union(
        b.select(*a.columns).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    )
    return marked.groupBy(*a.columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def _repeated(counted, n, copies):
    """The rows once, or `n` times; the copies of a frequent row are dealt over all tasks."""
    if copies:
        counted = numbered_copies(counted.withColumn("_n", n), "_n", "_i")
    return counted.drop("_l", "_r", "_n", "_i")


def common(a: DataFrame, b: DataFrame, copies=False) -> DataFrame:
    """Rows in both tables, once or as often as in both."""
    n = F.least("_l", "_r")
    return _repeated(_counted(a, b).where(n > 0), n, copies)


def minus(a: DataFrame, b: DataFrame, copies=False) -> DataFrame:
    """Rows of `a` not in `b`; with `copies`, as often as `a` has more of them."""
    n = F.col("_l") - F.col("_r")
    keep = n > 0 if copies else (F.col("_l") > 0) & (F.col("_r") == 0)
    return _repeated(_counted(a, b).where(keep), n, copies)


def sample_stable(df: DataFrame, key: str, percent: int) -> DataFrame:
    """The rows whose key falls into the first `percent` of 100 buckets."""
    return df.where(stable_bucket(F.col(key)) < percent)
