"""Joins."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import as_list, each_group
from millrace.functions.sizing import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small


def _on(left: DataFrame, right: DataFrame, on: Mapping[str, str]):
    return [left[a] == right[b] for a, b in on.items()]


def enrich(
    fact, dim, on: Mapping[str, str], max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES
) -> DataFrame:
    """Left join to a dimension: broadcast if it was measured small, else shuffled."""
    dim = broadcast_if_small(dim, max_rows=max_rows, max_bytes=max_bytes)
    return fact.join(dim, _on(fact, dim, on), "left")


def join_facts(a: DataFrame, b: DataFrame, on: Mapping[str, str], how="inner") -> DataFrame:
    """Equi-join of two large tables; AQE splits the partitions of frequent keys.

    AQE splits either side of an inner join, but only one of an outer join. So an
    outer join is the inner one and the rows without a partner, found by an anti join
    with the distinct keys of the other side.
    """
    inner = a.join(b, _on(a, b, on))
    if how == "inner":
        return inner
    if how not in ("left", "full"):
        return a.join(b, _on(a, b, on), how)

    def alone(rows, other, names):
        keys = other.select(*[F.col(o).alias(f"_k_{o}") for _, o in names]).distinct()
        return rows.join(keys, [rows[r] == keys[f"_k_{o}"] for r, o in names], "left_anti")

    def nulls(rows):
        return [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]

    pairs = list(on.items())
    out = inner.union(alone(a, b, pairs).select("*", *nulls(b)))
    if how == "full":
        out = out.union(alone(b, a, [(v, k) for k, v in pairs]).select(*nulls(a), "*"))
    return out


def keep_known(a: DataFrame, b: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of `a` whose key exists in `b`.

    Keys of `b` are made distinct first: a frequent one is then one row per map
    task, and the join uses the same shuffle.
    """
    keys = b.select(*[F.col(v).alias(f"_k_{k}") for k, v in on.items()]).distinct()
    return a.join(keys, [a[k] == keys[f"_k_{k}"] for k in on], "left_semi")


def asof(
    left: DataFrame,
    right: DataFrame,
    by,
    ts: str,
    take: Mapping[str, str],
    tie: str,
    left_id: str,
) -> DataFrame:
    """Each left row with the latest right row of its `by` group at or before its `ts`.

    `take` maps right columns to output names, null without a match. Right rows
    of equal time are ordered by `tie`; `left_id` orders equal left rows. Rows with a
    null key or time have no match. One
    shuffle serves both sides: rows are stacked, and the last right row seen is carried
    down, from part to part where a group is cut.
    """
    by = as_list(by)
    # As in SQL, a null key or time matches nothing.
    placed = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, ts]])
    unplaced, left, right = left.where(~placed), left.where(placed), right.where(placed)
    rest = [c for c in left.columns if c not in [*by, ts]]
    picked = [F.col(r).alias(o) for r, o in take.items()]
    stacked = (
        left.select(
            *by,
            ts,
            F.lit(1).alias("_side"),
            F.col(left_id).alias("_tie"),
            F.struct(*rest).alias("_left"),
        )
    ).unionByName(
        right.select(
            *by,
            ts,
            F.lit(0).alias("_side"),
            F.col(tie).alias("_tie"),
            F.struct(*picked).alias("_right"),
        ),
        allowMissingColumns=True,
    )

    def body(rows):
        rows = rows.running_last("_match", F.col("_right"))
        return rows.df.where("_side = 1").select(
            *by, ts, "_left.*", *[F.col(f"_match.{o}").alias(o) for o in take.values()]
        )

    result = each_group(stacked, by, [ts, "_side", "_tie"], body)
    result = result.select(*left.columns, *take.values())
    return result.unionByName(unplaced, allowMissingColumns=True)


def within(
    a: DataFrame, b: DataFrame, by, a_ts: str, b_ts: str, seconds: int, prefix="b_"
) -> DataFrame:
    """Pairs with equal `by` and `a_ts` <= `b_ts` <= `a_ts` + `seconds`.

    Time is cut into cells as long as the interval, so `b` is in the cell of `a`
    or the next one. `a` goes to both, and the equi-join is on (by, cell): a busy
    `by` value is spread over its cells, and AQE splits a cell that is too large.
    Columns of `b` get `prefix`.
    """
    by = as_list(by)
    right = b.select(*[F.col(c).alias(prefix + c) for c in b.columns])
    cell_a, cell_b = time_cell(a_ts, seconds), time_cell(prefix + b_ts, seconds)
    left = a.withColumn("_cell", F.explode(F.array(cell_a, cell_a + 1)))
    right = right.withColumn("_b_cell", cell_b)
    gap = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    on = [
        *[left[k] == right[prefix + k] for k in by],
        left["_cell"] == right["_b_cell"],
        right[prefix + b_ts] >= left[a_ts],
        right[prefix + b_ts] <= left[a_ts] + gap,
    ]
    return left.join(right, on).drop("_cell", "_b_cell")


def time_cell(ts: str, seconds: int):
    """Number of the `seconds`-long cell a timestamp falls into."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (int(seconds) * 1_000_000))
