"""Windowed aggregation of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import as_list


def sliding(stream: DataFrame, ts: str, length: str, slide: str | None, delay: str, *aggs: Column, by=()) -> DataFrame:
    """Aggregates per window and `by`; append mode gives a window when the watermark passes it."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    grouped = stream.withWatermark(ts, delay).groupBy(window.alias("w"), *as_list(by))
    return grouped.agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def tumbling(stream: DataFrame, ts: str, length: str, delay: str, *aggs: Column, by=()) -> DataFrame:
    return sliding(stream, ts, length, None, delay, *aggs, by=by)


def sessions(stream: DataFrame, by, ts: str, gap: str, delay: str, *aggs: Column) -> DataFrame:
    """Sessions per `by`: rows less than `gap` apart."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *as_list(by))
    return grouped.agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")
