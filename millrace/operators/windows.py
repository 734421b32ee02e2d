"""Ordered work: latest rows, sessions, changes, moving frames, versions, top-k."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.groups import OrderedRows, as_list, each_group, joined_groups, named
from millrace.session import checkpointed


#: Above so many rows per group a top-k is ranked in parts.
LARGE_K = 10_000


def top_k(df: DataFrame, by, order, k: int) -> DataFrame:
    """The first `k` rows of each group; map tasks cut groups before the shuffle.

    That cut is of no use for a large `k`, and one task would sort what is left of a large
    group. Above LARGE_K rows are range-partitioned by group and order instead: the rank
    is a row's number in its partition, and the rows of its group in those before.
    """
    by = as_list(by)
    if k > LARGE_K:
        ranked = _ranked(df, by, order)
    else:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def _ranked(df, by, order):
    """`df` with `_rank`, without a window over its groups."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *named(by), *order).sortWithinPartitions(*named(by), *order)
    # Written, so that numbers given by place stay the same.
    placed = checkpointed(placed.withColumn("__id", F.monotonically_increasing_id()))
    # Ids are numbers within a partition, and the partition's above 33 bits.
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(*named(by), part.alias("__of")).agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*named(by)).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*named(by), "__of", "__low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("__before"))
    ranked = joined_groups(placed, sizes, by, part == F.col("__of"), how="inner")
    return ranked.withColumn("_rank", F.col("__id") - F.col("__low") + F.col("__before") + 1).drop("__id", "__of", "__low", "__before")


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key by `order`."""
    return top_k(df, keys, [F.col(c).desc() for c in as_list(order)], 1)


def sessionise(
    df: DataFrame, by, ts: str, tie: str, seconds: int, *aggs: Column
) -> DataFrame:
    """Sessions per `by`: a row more than `seconds` after the one before starts one.

    Gives session number, first and last time, rows, and the given aggregates. A row
    without a time is a session of its own. Numbering shares one shuffle; a session is
    combined on the map side before it is grouped.
    """
    by = as_list(by)
    gap = F.expr(f"INTERVAL {int(seconds)} SECONDS")

    def body(rows: OrderedRows) -> DataFrame:
        rows = rows.previous("_before", ts)
        starts = F.coalesce(F.col(ts) > F.col(f"_before.{ts}") + gap, F.lit(True))
        rows = rows.running_sum("session", F.when(starts, 1).otherwise(0).cast("long"))
        return rows.df.groupBy(*by, "session").agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.count(F.lit(1)).alias("rows"),
            *aggs,
        )

    return each_group(df, by, [ts, tie], body)


def changes(df: DataFrame, by, order, col: str) -> DataFrame:
    """Rows whose `col` differs from the row before, with that value as `previous`."""

    def body(rows: OrderedRows) -> DataFrame:
        rows = rows.previous("_before", col)
        before = F.col("_before")
        changed = before.isNull() | ~F.col(col).eqNullSafe(before[col])
        return (
            rows.df.where(changed).withColumn("previous", before[col]).drop("_before")
        )

    return each_group(df, by, order, body)


def rolling(
    df: DataFrame,
    by,
    order,
    rows: int,
    aggregates: Mapping[str, Callable],
) -> DataFrame:
    """Aggregates over each row and the `rows` - 1 before it.

    `aggregates` maps output names to functions from a window to a column, such
    as `lambda w: F.sum("value").over(w)`.
    """
    return each_group(df, by, order, lambda r: r.moving(rows, dict(aggregates)).df)


def rolling_time(df: DataFrame, by, ts: str, seconds: int, value: str) -> DataFrame:
    """Per `by` and distinct `ts`: rows, sum, minimum and maximum of `value` from
    `seconds` before up to and including `ts`. Rows without a time are in no frame.

    Rows of equal time are one point first. Time is cut into cells as long as the frame,
    so a frame is the end of one cell and the beginning of the next. The beginning is
    what a cell has up to the point. For the end each point is also asked for in the cell
    before, at the time its frame begins, and gets what that cell has from there on. Both
    are running aggregates, linear in the points however many are in one frame, and
    nothing is subtracted, so sums lose no digits.
    """
    by = as_list(by)
    kinds = {"rows": "sum", "total": "sum", "lowest": "min", "highest": "max"}
    points = df.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(value).alias("_total"),
        F.min(value).alias("_lowest"),
        F.max(value).alias("_highest"),
    )
    size = int(seconds) * 1_000_000
    points = points.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    points = points.withColumn("_cell", F.expr(f"(_at - pmod(_at, {size}L)) div {size}L"))
    none = [F.lit(None).cast(points.schema[f"_{k}"].dataType).alias(f"_{k}") for k in kinds]
    asked = points.select(*by, ts, *none, (F.col("_at") - size).alias("_at"), (F.col("_cell") - 1).alias("_cell"))
    # Points stand behind what is asked for at the same time, so that it holds them.
    stacked = points.withColumn("_point", F.lit(1)).unionByName(asked.withColumn("_point", F.lit(0)))

    def body(rows: OrderedRows):
        upto, onward = rows, rows
        for name, kind in kinds.items():
            upto = upto.running(name, kind, F.col(f"_{name}"))
            onward = onward.running(name, kind, F.col(f"_{name}"), reverse=True)
        found = [*named([*by, ts]), *kinds]
        return upto.df.where("_point = 1").select(*found).unionByName(onward.df.where("_point = 0").select(*found))

    parts = each_group(stacked, [*by, "_cell"], ["_at", "_point"], body)
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(*by, ts).agg(*[folds[kind](name).alias(name) for name, kind in kinds.items()])


def history(df: DataFrame, keys, ts: str, tie: str) -> DataFrame:
    """Versions per key: `valid_from`, `valid_to` (null while valid) and `current`."""

    def body(rows: OrderedRows) -> DataFrame:
        rows = rows.following("_next", ts)
        out = rows.df.withColumn("valid_to", F.col(f"_next.{ts}"))
        out = out.withColumn("current", F.col("_next").isNull()).drop("_next")
        return out.withColumnRenamed(ts, "valid_from")

    return each_group(df, keys, [ts, tie], body)


#: Rows in one array.
SEGMENT_ROWS = 1000


def assemble(df: DataFrame, by, order, columns, name="rows", rows: int | None = None) -> DataFrame:
    """Rows of each group in order as arrays of at most `rows` (default SEGMENT_ROWS) structs.

    Gives `by`, `segment` (from 0), `first` (the number of its first row in the group, from
    0) and the array `name` of structs of `columns`. Rows are numbered first, so a group
    with very many rows is many segments, each put together and sorted by itself; no
    array grows with the group. `order` must tell the rows of a group apart, or equal ones
    stand in any order.
    """
    by, size = as_list(by), rows or SEGMENT_ROWS
    numbered = each_group(df, by, order, lambda found: found.running_sum("_number", F.lit(1).cast("long")).df)
    segment = F.floor((F.col("_number") - 1) / size)
    made = numbered.select(*named(by), segment.alias("segment"), F.struct("_number", F.struct(*named(as_list(columns))).alias("row")).alias("_row"))
    made = made.groupBy(*named(by), "segment").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return made.select(
        *named(by), "segment", (F.col("segment") * size).alias("first"), F.transform("_rows", lambda x: x["row"]).alias(name)
    )
