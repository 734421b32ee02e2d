"""Rows repeated by a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 100_000


def numbered_copies(df: DataFrame, n: str, number: str, chunk=CHUNK) -> DataFrame:
    """Each row once for every `number` from 0 to its column `n` - 1; none if `n` < 1.

    A row with more than `chunk` copies is cut into chunks first, which are dealt over
    all tasks, so that no task writes the copies of a frequent row alone. Their number of
    partitions is given, as adaptive execution would merge these few short rows.
    """
    df = df.withColumn(n, F.col(n).cast("long"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = df.where((F.col(n) >= 1) & (F.col(n) <= chunk))
    few = few.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))
    many = df.where(F.col(n) > chunk).withColumn("_chunk", F.explode(chunks))
    begin = F.col("_chunk") * chunk
    last = F.least(F.col(n), begin + chunk) - 1
    many = many.repartition(parts, "_chunk").withColumn(number, F.explode(F.sequence(begin, last)))
    return few.unionByName(many.drop("_chunk"))
