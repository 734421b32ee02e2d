"""Size checks that decide on a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory bytes, from one aggregation over `df`."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """True if `df` was counted and weighed within both limits.

    The count comes first: on a plain table it needs only file metadata, so a
    large table is never read just to be turned down.
    """
    return df.count() <= max_rows and measured_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, **limits) -> DataFrame:
    """`df` with a broadcast hint if it is small, else unchanged for AQE to plan."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df
