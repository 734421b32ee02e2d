"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.groups import as_list, joined_groups, large_groups, named
from millrace.session import checkpointed


def summarise(df: DataFrame, by, *aggs: Column) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(*aggs)


def summarise_levels(df: DataFrame, by, *aggs: Column, kind="rollup", sets=None) -> DataFrame:
    """Subtotals: a rollup, a cube, or the given grouping sets."""
    by = as_list(by)
    if sets is not None:
        grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    else:
        grouped = df.rollup(*by) if kind == "rollup" else df.cube(*by)
    return grouped.agg(*aggs)


def distinct_estimate(df: DataFrame, by, col: str, error=0.05) -> DataFrame:
    """Approximate number of distinct values per group, from mergeable sketches."""
    return df.groupBy(*as_list(by)).agg(
        F.approx_count_distinct(col, error).alias("distinct_values")
    )


#: Rows of a group, or distinct values of a bracket, that one task takes; steps of a histogram.
SELECT_ROWS = 1_000_000
STEPS = 200


def quantiles(df: DataFrame, by, col: str, ps: Sequence[float], rows: int | None = None) -> DataFrame:
    """Exact quantiles per group with linear interpolation, one row per `p`.

    Groups of up to `rows` rows (default SELECT_ROWS) take the built-in aggregate, which
    holds a group's counted values. In a larger one each quantile is selected: a histogram
    of the group, from mergeable sketches, gives the bracket of values around its rank; the
    rows of a bracket are counted by value, and those below it as a number. A bracket
    with more than `rows` distinct values is cut again in the same way. Groups without a
    value have null quantiles; null values do not count.
    """
    by, rows, ps = as_list(by), rows or SELECT_ROWS, [float(p) for p in ps]
    large = large_groups(df.where(F.col(col).isNotNull()), by, rows)
    if large is None:
        return _built_in(df, by, col, ps)
    small = joined_groups(df, large, by).where("__n is null").select(*df.columns)
    found = _selected(df.where(F.col(col).isNotNull()).select(*by, col), large, by, col, ps, rows)
    return _built_in(small, by, col, ps).unionByName(found)


def _built_in(df, by, col, ps):
    values = df.groupBy(*by).agg(F.percentile(col, F.array(*map(F.lit, ps))).alias("_v"))
    # A group without a value has no array.
    pairs = [F.struct(F.lit(p).alias("p"), F.get("_v", F.lit(i)).alias("value")) for i, p in enumerate(ps)]
    return values.select(*by, F.inline(F.array(*pairs)))


def _selected(df, large, by, col, ps, rows):
    """Quantiles of the groups in `large`, from the rows `df` without nulls.

    A target is a group and a `p`, with the ranks `_first` and `_last` of its two
    neighbouring values; `_below` rows lie under its bracket. A bracket begins and ends with
    values whose ranks were counted, so the outcome does not rest on the sketches' error.
    """
    at = F.col("p") * (F.col("_rows") - 1)
    targets = large.select(*named(by), F.col("__n").alias("_rows"), F.explode(F.array(*map(F.lit, ps))).alias("p"))
    targets = targets.withColumn("_first", F.floor(at)).withColumn("_last", F.ceil(at))
    targets = checkpointed(targets.withColumn("_below", F.lit(0).cast("long")))
    raw = joined_groups(df.select(*named(by), F.col(col).alias("_value")), large.select(*named(by)), by, how="inner")
    raw, keys = raw.withColumn("_n", F.lit(1).cast("long")), by
    most = None
    while True:
        closer = _brackets(targets, _steps(raw, keys), by, keys)
        held = joined_groups(raw, closer, keys, F.col("_value").between(F.col("_low"), F.col("_high")), how="inner")
        # Equal values, however frequent, are counted on the map side.
        raw = checkpointed(held.groupBy(*named(by), "p", "_value").agg(F.sum("_n").alias("_n")))
        targets, keys = closer, [*by, "p"]
        before, most = most, raw.groupBy(*named(keys)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most <= rows or most == before:
            break
    window = Window.partitionBy(*named(keys)).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined_groups(raw, targets, keys, how="inner").withColumn("_upto", F.col("_below") + F.sum("_n").over(window))

    def value_at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_value")))

    low, high = value_at(F.col("_first")), value_at(F.col("_last"))
    found = ranked.groupBy(*named(keys), "_rows").agg(low.alias("_a"), high.alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))
    return found.select(*named(keys), value.cast("double").alias("value"))


def _steps(rows, keys):
    """A histogram of `_value` per `keys`: rows, least and highest value of each step, and
    the rows up to it."""
    share = [F.lit(i / STEPS) for i in range(STEPS + 1)]
    edges = rows.groupBy(*named(keys)).agg(F.percentile_approx("_value", F.array(*share), 10 * STEPS).alias("_edges"))
    edges = checkpointed(edges.withColumn("_edges", F.array_distinct("_edges")))
    step = F.size(F.filter("_edges", lambda x: x < F.col("_value")))
    sized = joined_groups(rows, edges, keys, how="inner").groupBy(*named(keys), step.alias("_step"))
    sized = sized.agg(F.sum("_n").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    window = Window.partitionBy(*named(keys)).orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.select(*named(keys), "_lo", "_hi", F.sum("_n").over(window).alias("_upto"))


def _brackets(targets, sized, by, keys):
    """`targets` with the values from the step that holds the first rank to that of the last."""
    met = joined_groups(sized, targets.drop("_low", "_high"), keys, how="inner")
    upto = F.col("_below") + F.col("_upto")
    met = met.groupBy(*named(by), "p", "_rows", "_first", "_last", "_below").agg(
        F.min(F.when(upto > F.col("_first"), F.col("_lo"))).alias("_low"),
        F.min(F.when(upto > F.col("_last"), F.col("_hi"))).alias("_high"),
        F.max(F.when(upto <= F.col("_first"), upto)).alias("_under"),
    )
    return checkpointed(met.withColumn("_below", F.coalesce("_under", "_below")).drop("_under"))


def quantiles_estimate(df: DataFrame, by, col: str, ps: Sequence[float], accuracy=10_000):
    """Approximate quantiles per group, one row per `p`, from mergeable sketches."""
    by, ps = as_list(by), [float(p) for p in ps]
    sketched = df.groupBy(*by).agg(F.percentile_approx(col, ps, accuracy).alias("_v"))
    pairs = [
        F.struct(F.lit(p).alias("p"), F.col("_v")[i].alias("value")) for i, p in enumerate(ps)
    ]
    return sketched.select(*by, F.inline(F.array(*pairs)))
