"""Helpers for row-level work in Arrow batches, and free column names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bounds on one batch: rows sent to Python at once, and text bytes worked on at once.
BATCH_ROWS = 500
PIECE_BYTES = 1 << 19


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(texts, limit=PIECE_BYTES):
    """(from, to) row ranges of about `limit` characters; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def small_batches(spark):
    """Keep Arrow batches of long texts small in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, inputs, fields, prepare, keep=None) -> DataFrame:
    """Rows of `df` with new columns made from the columns `inputs`, order and count unchanged.

    `prepare()` runs once per task and gives a function of one list per input
    column (a range of rows of about half a megabyte of the first of them) that returns
    one list per new field. `keep` names the columns passed through (default all).
    """
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    carried = [i for i, c in enumerate(df.columns) if c in keep]
    read = [df.columns.index(c) for c in inputs]
    schema = T.StructType([df.schema.fields[i] for i in carried] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = prepare()
        for batch in batches:
            given = [batch.column(i).to_pylist() for i in read]
            for begin, end in pieces(given[0]):
                part = batch.slice(begin, end - begin)
                made = work(*[g[begin:end] for g in given])
                columns = [part.column(i).cast(arrow.field(k).type) for k, i in enumerate(carried)]
                columns += [
                    pa.array(values, type=arrow.field(len(carried) + k).type)
                    for k, values in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def flat_rows(df: DataFrame, inputs, schema, prepare, limit=PIECE_BYTES) -> DataFrame:
    """New rows made from the columns `inputs` of `df`; `prepare` as in `map_rows`, with
    pieces of about `limit` characters.

    The function returns one array per field of `schema`, of any common length.
    """
    small_batches(df.sparkSession)
    df = df.select(*[f"`{c}`" for c in inputs])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = prepare()
        for batch in batches:
            given = [batch.column(i).to_pylist() for i in range(len(inputs))]
            for begin, end in pieces(given[0], limit):
                made = work(*[g[begin:end] for g in given])
                columns = [
                    pa.array(values, type=arrow.field(k).type) for k, values in enumerate(made)
                ]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
