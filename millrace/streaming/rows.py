"""Row-level streaming: exact copies, interval matches, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.groups import as_list
from millrace.operators.joins import time_cell
from millrace.sources.streams import claim


def dedupe(stream: DataFrame, keys, ts: str, delay: str) -> DataFrame:
    """Each key's first row; keys are remembered until the watermark has passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(as_list(keys))


def match(a: DataFrame, b: DataFrame, by, a_ts: str, b_ts: str, seconds: int, delay: str, prefix="b_") -> DataFrame:
    """Pairs with equal `by` and `a_ts` <= `b_ts` <= `a_ts` + `seconds`.

    The join key holds a time cell, so the state of a busy `by` value is spread.
    """
    by = as_list(by)
    right = b.select(*[F.col(c).alias(prefix + c) for c in b.columns])
    right = right.withWatermark(prefix + b_ts, delay).withColumn("_b_cell", time_cell(prefix + b_ts, seconds))
    cell = time_cell(a_ts, seconds)
    left = a.withWatermark(a_ts, delay).withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    gap = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    on = [
        *[left[k] == right[prefix + k] for k in by],
        left["_cell"] == right["_b_cell"],
        right[prefix + b_ts] >= left[a_ts],
        right[prefix + b_ts] <= left[a_ts] + gap,
    ]
    return left.join(right, on).drop("_cell", "_b_cell")


def late_rows(
    stream: DataFrame, ts: str, seconds: int, path: str, checkpoint: str, every=None
) -> StreamingQuery:
    """Write all rows with a flag `late`: not after the watermark their batch ran under,
    which is whole milliseconds, as in Spark's own stateful operators.

    That watermark is the highest `ts` of all earlier batches less `seconds`.
    Each batch stores the highest `ts` so far, one row, for the next batch. Both
    writes overwrite the batch's own folders, so a repeated batch changes nothing.
    Flagged rows are kept under `path`/rows, which Spark's own late-row handling
    does not do. `every` is as in `write_batches`.
    """

    def tag(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        high = None
        if batch_id > 0:
            high = spark.read.parquet(f"{path}/high/batch_id={batch_id - 1}").first()["high"]
        mark = F.date_trunc("MILLISECOND", F.lit(high).cast("timestamp")) - F.expr(f"INTERVAL {int(seconds)} SECONDS")
        flagged = batch.withColumn("late", F.coalesce(F.col(ts) <= mark, F.lit(False)))
        rows = f"{path}/rows/batch_id={batch_id}"
        flagged.write.mode("overwrite").parquet(rows)
        # From the rows just written: one column, and no second read of the source.
        newest = spark.read.parquet(rows).agg(F.max(ts).alias("high"))
        newest = newest.select(F.greatest("high", F.lit(high).cast("timestamp")).alias("high"))
        newest.write.mode("overwrite").parquet(f"{path}/high/batch_id={batch_id}")

    claim(stream.sparkSession, path, checkpoint)
    return (
        stream.writeStream.foreachBatch(tag)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )
