"""Schemas, payloads, rules, profiles and reconciliation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.groups import as_list


def as_schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def conform(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of `schema`: absent ones null, values that do not cast null.

    Names are matched as the session matches them, by default whatever their case. A
    name that fits several columns is an error.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = Counter(c if exact else c.lower() for c in df.columns)
    present = {f.name for f in as_schema(schema).fields if found[f.name if exact else f.name.lower()]}
    for name in present:
        if found[name if exact else name.lower()] > 1:
            raise ValueError(f"several columns could be {name}")
    return df.select(
        *[
            (
                F.col(f"`{f.name}`").try_cast(f.dataType)
                if f.name in present
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in as_schema(schema).fields
        ]
    )


def parse_payload(df: DataFrame, col: str, schema, corrupt="_corrupt") -> DataFrame:
    """Replace JSON column `col` by the fields of `schema` and a corrupt-record column.

    The corrupt column holds the raw text of a payload that is not valid JSON or
    has a value of the wrong type, and null otherwise.
    """
    fields = as_schema(schema)
    full = T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(
        F.col(col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    )
    # Blank text gives no struct at all.
    blank = F.struct(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields], F.col(col).alias(corrupt)
    )
    parsed = F.coalesce(parsed, F.when(F.col(col).isNotNull(), blank))
    # As a generator it runs once per row, however many filters use its fields,
    # and filters on other columns still reach the scan.
    return df.select(*[c for c in df.columns if c != col], F.inline(F.array(parsed)))


def validate(df: DataFrame, rules: Mapping[str, Column], errors="_errors") -> DataFrame:
    """Add the names of the rules each row breaks; a rule that is null is broken."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    return df.withColumn(errors, F.array_compact(F.array(*broken)).cast("array<string>"))


def accepted(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break no rule. Rules are plain filters here and can reach the scan."""
    return df.where(reduce(Column.__and__, rules.values())) if rules else df


def quarantined(df: DataFrame, rules: Mapping[str, Column], errors="_errors") -> DataFrame:
    """The other rows, with the names of the rules they break."""
    good = F.coalesce(reduce(Column.__and__, rules.values(), F.lit(True)), F.lit(False))
    return validate(df.where(~good), rules, errors)


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, exact distinct values, and the lowest and highest value as text.

    Cells are counted as (column, value) first, which combines before the shuffle. The
    extremes are taken in the type of the column, so that numbers and times compare as
    such, by one aggregation without a shuffle of rows; only its single row is turned into
    text. Maps have no order and no extremes. Timestamps with a zone count as instants.
    """

    def value(field, column):
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(column).cast("string")
        return _as_text(field, column)

    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE)
    pairs = [F.struct(F.lit(f.name).alias("column"), value(f, F.col(f"`{f.name}`")).alias("value")) for f in fields]
    cells = df.select(F.inline(F.array(*pairs)))
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    )
    ordered = [(i, f) for i, f in enumerate(fields) if not _has_map(f.dataType)]
    extremes = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[g(f"`{f.name}`").alias(f"{name}{i}") for i, f in ordered for g, name in ((F.min, "low"), (F.max, "high"))],
    )
    none = F.lit(None).cast("string")
    texts = [
        F.struct(
            F.lit(f.name).alias("column"),
            *[
                (none if _has_map(f.dataType) else _as_text(f, F.col(f"{side}{i}"))).alias(name)
                for side, name in (("low", "lowest"), ("high", "highest"))
            ],
        )
        for i, f in enumerate(fields)
    ]
    # One row per column of the table.
    return counted.join(F.broadcast(extremes.select(F.inline(F.array(*texts)))), "column")


PROFILE = "column string, rows long, nulls long, distinct_values long, lowest string, highest string"


def _as_text(field, column):
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    if not nested:
        return column.cast("string")
    return F.when(column.isNotNull(), F.to_json(F.struct(column.alias(field.name))))


def _has_map(kind):
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of `child` without a parent; a frequent parent key is one row before the join."""
    keys = parent.select(*[F.col(v).alias(f"_k_{k}") for k, v in on.items()]).distinct()
    return child.join(keys, [child[k] == keys[f"_k_{k}"] for k in on], "left_anti")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with more copies on one side: `side` and the number `extra`."""
    marked = a.withColumn("_d", F.lit(1)).union(b.select(*a.columns).withColumn("_d", F.lit(-1)))
    counted = marked.groupBy(*a.columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    side = F.when(F.col("_d") > 0, F.lit("a")).otherwise(F.lit("b"))
    return counted.select(*a.columns, side.alias("side"), F.abs("_d").alias("extra"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys seen more than once, with their number of rows."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def python_rule(function: Callable, returns="boolean"):
    """A rule of a function of pandas series, run in Arrow batches."""
    return F.pandas_udf(function, returns)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """`function` of each Arrow batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(run, schema)
