"""File streams in, replay-safe batches out."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.groups import as_list
from millrace.operators.windows import latest_per_key, top_k
from millrace.session import scratch_path

STREAM_SETTINGS = {
    # State larger than memory, with small incremental state checkpoints.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def stream_settings(spark: SparkSession):
    """The streaming settings while a query starts; those before are put back."""
    before = {name: spark.conf.get(name, None) for name in STREAM_SETTINGS}
    for name, value in STREAM_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_event_stream(
    spark: SparkSession, path: str, schema: str, ts: str, max_files=None
) -> DataFrame:
    """Stream of the parquet files under `path`, with `ts` as a TIMESTAMP.

    Watermarks need that type, and stored event times have no zone: they are
    read in the session's zone, which should be UTC. `max_files` bounds a batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def _exists(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Bind the output folder `path` to one checkpoint.

    Batch numbers begin anew with each checkpoint, so another one would overwrite what
    is there. A second checkpoint, or one that was deleted, is refused.
    """
    owner = f"{path}/_owner"
    if _exists(spark, owner):
        begun = spark.read.text(owner).first()[0]
        if begun != checkpoint or not _exists(spark, checkpoint):
            raise ValueError(f"{path} was begun under the checkpoint {begun}")
    else:
        spark.createDataFrame([(checkpoint,)], "owner string").coalesce(1).write.text(owner)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode="append", keys=None, every=None
) -> StreamingQuery:
    """Write each micro-batch to its own folder.

    Stops when the present input is used up, or with `every`, such as
    "1 minute", goes on with a batch as often as that. A batch that is run again
    after a failure overwrites its own folder, so nothing is written twice. With
    `keys`, rows repeated within a batch are dropped, all but the lowest by a hash of
    its columns. A folder takes the batches of one checkpoint only.
    """
    claim(stream.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int):
        rows = batch
        if keys:
            order = [F.xxhash64(*[c for c, t in batch.dtypes if "map<" not in t])]
            rows = top_k(batch, keys, order, 1)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def read_batches(
    spark: SparkSession, path: str, mode="append", keys=None, schema=None
) -> DataFrame:
    """The result table held in the folders of `write_batches`.

    Append output is all batches; complete output is the last one; update output
    is each key's row from the last batch that has one. With a `schema` nothing is
    inferred, and a stream that had no input gives an empty table.
    """
    reader = spark.read
    if schema is not None:
        if not _exists(spark, path) or not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
            spark._jsc.hadoopConfiguration()
        ).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*")):
            return spark.createDataFrame([], schema)
        reader = reader.schema(schema)
    rows = reader.parquet(path)
    if mode == "complete":
        last = rows.agg(F.max("batch_id").alias("_last"))
        # One row.
        rows = rows.join(F.broadcast(last), F.col("batch_id") == F.col("_last"), "left_semi")
    if mode == "update":
        rows = latest_per_key(rows, keys, ["batch_id"])
    return rows.drop("batch_id")


def run_stream(stream: DataFrame, name: str, mode="append", keys=None) -> DataFrame:
    """Run `stream` over all present input and give back the result table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    with stream_settings(spark):
        query = write_batches(stream, f"{path}/rows", f"{path}/checkpoint", mode)
    query.awaitTermination()
    return read_batches(spark, f"{path}/rows", mode, keys, stream.schema)
