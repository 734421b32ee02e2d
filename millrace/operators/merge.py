"""Exact deduplication and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import as_list
from millrace.operators.windows import latest_per_key, top_k
from millrace.session import checkpointed, scratch_path
from millrace.sources import versions
from millrace.sources.tables import read_table


def dedupe_exact(df: DataFrame, content, keep: str) -> DataFrame:
    """One row per content, the one lowest in `keep`.

    Rows sort by a hash of the content first, so that wide content is compared
    only where hashes agree. Copies are reduced to one row in each map task
    before the shuffle.
    """
    content = as_list(content)
    marked = df.withColumn("_hash", F.xxhash64(*content))
    return top_k(marked, ["_hash", *content], [F.col(keep)], 1).drop("_hash")


def _same_keys(target, changes, keys):
    """The keys of `changes`, and the condition that a row of `target` has one of them."""
    known = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return known, [target[k].eqNullSafe(known[f"_k_{k}"]) for k in keys]


def upsert(target: DataFrame, changes: DataFrame, keys, order) -> DataFrame:
    """`target` with changed rows replaced and new ones added.

    Keys come from the final changes, one row each, and AQE broadcasts them if they are
    small. A null key is a key like any other. Of several changes to a key the last by
    `order` counts. Columns of `changes` beyond those of `target` are not kept. Write the
    result to a new path: a plain table cannot be read and overwritten in one job.
    """
    keys = as_list(keys)
    final = latest_per_key(changes, keys, order)
    kept = target.join(*_same_keys(target, final, keys), "left_anti")
    return kept.unionByName(final.select(*target.columns))


def upsert_partitions(path: str, schema, changes: DataFrame, keys, order, by: str) -> None:
    """`upsert` into the table at `path`, partitioned by `by`, rewriting touched partitions only.

    Touched are the partitions of the changes and those that hold a changed key now, so
    a key may move. The result is written to the shared folder before the table is
    touched. A partition that would lose its last row is refused before anything is
    written: this function replaces folders and never deletes one. Replacing partitions
    is not one atomic step: until the call returns readers should use a copy, and after a
    failure in it the call must be repeated. `upsert_versioned` has neither limit.
    """
    spark, keys = changes.sparkSession, as_list(keys)
    final = checkpointed(latest_per_key(changes, keys, order))
    target = read_table(spark, path, schema)
    held = target.join(*_same_keys(target, final, keys), "left_semi")
    touched = checkpointed(final.select(by).union(held.select(by)).distinct())
    touched = touched.withColumnRenamed(by, "_touched")
    old = target.join(touched, target[by].eqNullSafe(touched["_touched"]), "left_semi")
    staged = scratch_path(spark, "upsert")
    upsert(old, final, keys, order).write.parquet(staged)
    merged = spark.read.parquet(staged)
    left = merged.select(F.col(by).alias("_left")).distinct()
    emptied = touched.join(left, touched["_touched"].eqNullSafe(left["_left"]), "left_anti")
    if not emptied.isEmpty():
        raise ValueError(f"a partition of {path} would lose its last row")
    writer = merged.hint("rebalance", by).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_versioned(path: str, schema, changes: DataFrame, keys, order, by: str) -> int:
    """`upsert` into the table of versions at `path`, partitioned by `by`; the new version's number.

    Only the partitions of the changes and those that hold a changed key now are written
    anew; the new version points to the old folders of the others. A partition may lose
    its last row. Until the version is written, in one small last step, readers see the
    table as it was; a call that was stopped before leaves it so, and can be repeated.
    """
    spark, keys = changes.sparkSession, as_list(keys)
    before = versions.last_version(spark, path)
    final = checkpointed(latest_per_key(changes, keys, order))
    target = versions.read_versioned(spark, path, schema, before)
    held = target.join(*_same_keys(target, final, keys), "left_semi")
    touched = checkpointed(final.select(by).union(held.select(by)).distinct())
    old, kept = versions.partition_rows(spark, path, schema, by, touched)
    return versions.write_version(upsert(old, final, keys, order), path, by, kept, before)
