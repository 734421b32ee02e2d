"""A partitioned table whose changes show at once: data in fresh folders, and a small pointer.

Under the table's path, `data` has one folder per write, partitioned by a column, and
`versions` one small table per version: the folders that hold its partitions. A write puts
its data down first and its version last, under the next number; readers take the highest
version that is complete. So a reader sees the old or the new table, a write that stops
half way changes nothing, and it can simply be run again. Nothing is ever deleted: old
versions can be read until their folders are cleared away by other means.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import write_partitioned

POINTER = "folder string"


def _complete(spark: SparkSession, path: str):
    """Numbers of the complete versions, from the file system that holds `path`."""
    jvm = spark._jvm.org.apache.hadoop.fs
    mark = jvm.Path(f"{path}/versions/version=*/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark)
    names = [str(f.getPath().getParent().getName()) for f in found or []]
    return sorted(int(n.partition("=")[2]) for n in names)


def last_version(spark: SparkSession, path: str) -> int | None:
    return max(_complete(spark, path), default=None)


def _folders(spark, path, version):
    """The folders of a version, below `data`: as many as the table has partitions."""
    rows = spark.read.schema(POINTER).parquet(f"{path}/versions/version={version}").collect()
    return [r["folder"] for r in rows]


def _read(spark, path, schema, folders):
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    found = reader.parquet(*[f"{path}/data/{f}" for f in folders])
    return found.select(*spark.createDataFrame([], schema).columns)


def read_versioned(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The table at `path` under `schema`: its last complete version, or an earlier one."""
    version = last_version(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"no complete version at {path}")
    return _read(spark, path, schema, _folders(spark, path, version))


def partition_rows(spark: SparkSession, path: str, schema, by: str, values: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of the partitions in `values` (column `by`) of the last version, and the
    folders of all other partitions."""
    folders = _folders(spark, path, last_version(spark, path))
    # One row per partition; names are as the writer escaped them.
    wanted = {r["name"] for r in values.select(_name(by).alias("name")).distinct().collect()}
    touched = [f for f in folders if f.partition("/")[2] in wanted]
    return _read(spark, path, schema, touched), [f for f in folders if f not in set(touched)]


def _name(by):
    """The folder name of a partition value, with the characters escaped that Spark escapes."""
    text = F.col(f"`{by}`").cast("string")
    escaped = F.regexp_replace(text, "%", "%25")
    # The other characters that are not written as they are.
    for letter in "\"#'*/:=?\\\x7f{[]^" + "".join(map(chr, range(1, 32))):
        escaped = F.replace(escaped, F.lit(letter), F.lit(f"%{ord(letter):02X}"))
    empty = text.isNull() | (text == "")
    return F.concat(F.lit(f"{by}="), F.when(empty, F.lit("__HIVE_DEFAULT_PARTITION__")).otherwise(escaped))


def write_version(df: DataFrame, path: str, by: str, kept: list[str] | None = None, before: int | None = None) -> int:
    """Writes `df`, partitioned by `by`, and a version of it and the folders `kept`.

    `before` is the version this one follows, None for a new table. Of two writers that
    follow the same version the second fails, as its number is taken.
    """
    spark, name = df.sparkSession, f"write={uuid.uuid4().hex}"
    if before is None and last_version(spark, path) is not None:
        raise ValueError(f"there is a table at {path}")
    data = f"{path}/data/{name}"
    write_partitioned(df, data, by)
    jvm = spark._jvm.org.apache.hadoop.fs
    found = jvm.Path(f"{data}/*=*")
    made = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    folders = [*(kept or []), *[f"{name}/{f.getPath().getName()}" for f in made or []]]
    number = 0 if before is None else before + 1
    # Written whole under another name, so that a stop leaves no half version in the way.
    fresh, final = jvm.Path(f"{path}/versions/new-{uuid.uuid4().hex}"), jvm.Path(f"{path}/versions/version={number}")
    spark.createDataFrame([(f,) for f in folders], POINTER).coalesce(1).write.parquet(fresh.toString())
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(final) or not files.rename(fresh, final):
        raise ValueError(f"version {number} of {path} exists")
    return number
