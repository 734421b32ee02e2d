"""Ordered work within groups: windows that share one shuffle, also where a group is very large.

A group of up to `split_rows` rows is one window partition. A larger one is cut into parts
by splitters of its order, found from a sample, and its parts are window partitions of
their own. What a row needs from the parts before or after it (a sum so far, the last row,
the last value) comes from one summary row per part: these few rows are scanned in order,
and the outcome is joined back to the part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.sizing import broadcast_if_small
from millrace.session import checkpointed

#: Rows of a group that one task takes; parts of a group; sampled rows per part.
SPLIT_ROWS = 1_000_000
MOST_PARTS = 10_000
SAMPLED = 32
PART = "__part"


def as_list(names):
    return [names] if isinstance(names, str) else list(names)


def named(names):
    return [F.col(f"`{n}`") for n in names]


def large_groups(df: DataFrame, by, rows: int) -> DataFrame | None:
    """The groups with more than `rows` rows and their number `__n`; None if there are none.

    They are at most as many as the table's rows divided by `rows`. A table that has no more
    rows than that in all, which a plain scan knows from its files, is not grouped.
    """
    if df.count() <= rows:
        return None
    counted = df.groupBy(*named(by)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    return None if counted.isEmpty() else checkpointed(counted)


def joined_groups(df: DataFrame, groups: DataFrame, by, *more: Column, how="left") -> DataFrame:
    """`df` joined to `groups` on `by`, null keys included; groups are sent out if small."""
    groups = groups.select(*[F.col(f"`{c}`").alias(f"_g_{c}" if c in by else c) for c in groups.columns])
    on = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_g_{c}`")) for c in by], F.lit(True))
    on = reduce(Column.__and__, more, on)
    return df.join(broadcast_if_small(groups), on, how).drop(*[f"_g_{c}" for c in by])


def _splitters(df, by, order, large, rows):
    """Per large group: `__at`, the sorted keys at which a new part begins."""
    parts = F.least(F.ceil(F.col("__n") / rows), F.lit(MOST_PARTS))
    share = parts * SAMPLED / F.col("__n")
    key = F.struct(*named(order))
    draw = F.pmod(F.xxhash64(*named([*by, *order])), F.lit(1 << 30)) / (1 << 30)
    sample = joined_groups(df, large.withColumn("__parts", parts).withColumn("__share", share), by, how="inner")
    sample = sample.where(draw < F.col("__share"))
    sample = sample.groupBy(*named(by)).agg(F.sort_array(F.collect_list(key)).alias("__s"), F.max("__parts").alias("__parts"))
    at = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("__parts") - 1),
        lambda i: F.element_at("__s", (F.floor(i * F.size("__s") / F.col("__parts")) + 1).cast("int")),
    )
    return checkpointed(sample.where("__parts > 1").select(*named(by), F.array_distinct(at).alias("__at")))


def _part_of(key):
    """How many splitters of `__at` are at or below `key`: first among every so many, then
    among those between."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__at")))).cast("int")
    tops = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__at") - 1) / step).cast("int")), lambda j: F.element_at("__at", j * step + 1)
    )
    below = F.size(F.filter(tops, lambda x: x <= key))
    first = (below - 1) * step
    between = F.size(F.filter(F.slice("__at", F.greatest(first, F.lit(0)) + 1, step), lambda x: x <= key))
    return F.when(F.col("__at").isNull(), F.lit(-1)).when(below == 0, F.lit(0)).otherwise(first + between)


def _fold(kind, column):
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](column)


def _folded(kind, a, b):
    """Two results of the same kind; one that is null does not count."""
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


@dataclass
class OrderedRows:
    """Rows in order within groups; each method adds a column.

    `split` tells that large groups are cut: column `__part` is then the number of the part,
    -1 in groups that are whole. `order` must tell all rows of a large group apart, or
    equal ones stay together.
    """

    df: DataFrame
    by: list
    order: list
    rows: int = SPLIT_ROWS
    split: bool = False

    def _window(self, reverse=False):
        order = [c.desc() if reverse else c.asc() for c in named(self.order)]
        return Window.partitionBy(*named(self.by), *([PART] if self.split else [])).orderBy(*order)

    def _with(self, name, column):
        return replace(self, df=self.df.withColumn(name, column))

    def _carried(self, name, summary, carry, combine, local, reverse=False):
        """Column `name`: `combine` of `local` and what is carried into the row's part.

        `summary` aggregates a part to `__s`; `carry` is a function of the window over
        the summaries of a group in order.
        """
        if not self.split:
            return self._with(name, local)
        parts = self.df.where(F.col(PART) >= 0).groupBy(*named(self.by), PART).agg(summary.alias("__s"))
        window = Window.partitionBy(*named(self.by)).orderBy(F.col(PART).desc() if reverse else F.col(PART).asc())
        parts = checkpointed(parts.select(*named(self.by), F.col(PART).alias("__of"), carry(window).alias("__c")))
        df = joined_groups(self.df.withColumn(name, local), parts, self.by, F.col(PART) == F.col("__of"))
        return replace(self, df=df.withColumn(name, combine(F.col(name), F.col("__c"))).drop("__of", "__c"))

    def _key(self):
        return F.struct(*named(self.order))

    def previous(self, name, *columns):
        """The row before, as a struct of `columns`; null for the first."""
        row = F.struct(*named(columns))
        return self._carried(
            name, F.max_by(row, self._key()), lambda w: F.lag("__s").over(w), F.coalesce, F.lag(row).over(self._window())
        )

    def following(self, name, *columns):
        """The row after, as a struct of `columns`; null for the last."""
        row = F.struct(*named(columns))
        return self._carried(
            name, F.min_by(row, self._key()), lambda w: F.lead("__s").over(w), F.coalesce, F.lead(row).over(self._window())
        )

    def running(self, name, kind, column, reverse=False):
        """The `kind` ("sum", "min", "max") of `column` up to each row, or from it on."""
        upto = self._window(reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._carried(
            name, _fold(kind, column),
            lambda w: _fold(kind, F.col("__s")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda a, b: _folded(kind, a, b), _fold(kind, column).over(upto), reverse,
        )

    def running_sum(self, name, column):
        return self.running(name, "sum", column)

    def running_last(self, name, column):
        """The last value so far that is not null."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._carried(
            name, F.max_by(column, F.when(column.isNotNull(), self._key())),
            lambda w: F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce, F.last(column, ignorenulls=True).over(upto),
        )

    def moving(self, rows, aggregates):
        """Aggregates over each row and the `rows` - 1 before it.

        Large groups are cut anew into blocks by row number; the last rows of a block go
        to the next one too, where they are only looked at.
        """
        numbered, by = self, list(self.by)
        if self.split:
            size = max(self.rows, rows)
            numbered = self.running_sum("__n", F.lit(1).cast("long"))
            block = F.when(F.col(PART) >= 0, F.floor((F.col("__n") - 1) / size)).otherwise(0)
            near = (F.col(PART) >= 0) & ((F.col("__n") - 1) % size > size - rows)
            own = F.struct(block.alias("__block"), F.lit(True).alias("__own"))
            next_one = F.struct((block + 1).alias("__block"), F.lit(False).alias("__own"))
            both = F.when(near, F.array(own, next_one)).otherwise(F.array(own))
            numbered = replace(numbered, df=numbered.df.select("*", F.inline(both)))
            by.append("__block")
        frame = Window.partitionBy(*named(by)).orderBy(*named(self.order)).rowsBetween(1 - rows, Window.currentRow)
        df = numbered.df
        for name, function in aggregates.items():
            df = df.withColumn(name, function(frame))
        return replace(self, df=df.where("__own").drop("__n", "__block", "__own") if self.split else df)


def each_group(df: DataFrame, by, order, body, rows: int | None = None) -> DataFrame:
    """`body` of the rows of `df` in `order` within each `by` group.

    Groups of more than `rows` rows (default SPLIT_ROWS) are cut into parts, which needs
    the group sizes first: one aggregation over the keys.
    """
    by, order, rows = as_list(by), as_list(order), rows or SPLIT_ROWS
    large = large_groups(df, by, rows)
    if large is not None:
        points = _splitters(df, by, order, large, rows)
        cut = joined_groups(df, points, by).withColumn(PART, _part_of(F.struct(*named(order)))).drop("__at")
        return body(OrderedRows(cut, by, order, rows, True)).drop(PART)
    return body(OrderedRows(df, by, order, rows))
