"""Session settings, and the shared folder that jobs write scratch tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app="millrace", master=None, **settings) -> SparkSession:
    """A session with the library's settings.

    `spark.sql.shuffle.partitions` is left to the cluster unless given here: at
    100 TB it should be in the tens of thousands, and AQE merges small ones.
    Keyword names use `__` for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {name.replace("__", "."): str(value) for name, value in settings.items()}
    for name, value in {**SETTINGS, **given}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, made active for `checkpoint()`.

    Only a local session may go without one; it gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if active is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = named or tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
        active = context.getCheckpointDir()
    return named or active


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Write `df` to the shared folder and read it back, cutting its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
