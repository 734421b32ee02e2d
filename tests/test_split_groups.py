"""Ordered work with large groups cut into many parts: the same as plain windows and SQL."""

import math
import random
from collections import Counter

import pytest
from compare import rows, rows_of
from pyspark.sql import functions as F

from millrace.functions import groups
from millrace.functions.groups import OrderedRows, each_group
from millrace.operators import aggregates, joins, windows

SCHEMA = "id long, k string, t timestamp, v double, kind string"


def _table(spark, n=900, seed=1):
    """Half of the rows have one key; times tie, some are null, and so is a key."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        at = None if i % 97 == 0 else f"2024-01-0{1 + rng.randrange(5)} {rng.randrange(24):02}:{rng.choice('0123')}0:00"
        made.append((i, key, at, rng.choice([None, *map(float, range(9))]), rng.choice("xyz")))
    return spark.createDataFrame(made, "id long, k string, t string, v double, kind string").withColumn("t", F.col("t").cast("timestamp"))


@pytest.fixture
def cut(monkeypatch):
    """Parts of about 20 rows, and a look at how the rows are dealt."""
    seen = []
    real = groups._part_of

    def part_of(key):
        seen.append(1)
        return real(key)

    monkeypatch.setattr(groups, "_part_of", part_of)

    def switch(on):
        seen.clear()
        monkeypatch.setattr(groups, "SPLIT_ROWS", 20 if on else 1_000_000)
        monkeypatch.setattr(aggregates, "SELECT_ROWS", 20 if on else 1_000_000)
        return seen

    return switch


def _same(cut, make):
    cut(False)
    plain = make()
    assert not cut(False)
    want = Counter(tuple(r) for r in plain.collect())
    seen = cut(True)
    split = make()
    assert seen, "no group was cut"
    assert split.columns == plain.columns and split.dtypes == plain.dtypes
    assert Counter(tuple(r) for r in split.collect()) == want
    return plain


def test_sessions_changes_versions(spark, cut):
    df = _table(spark)
    _same(cut, lambda: windows.sessionise(df, "k", "t", "id", 1800, F.max("v").alias("m")))
    _same(cut, lambda: windows.changes(df, "k", ["t", "id"], "kind"))
    _same(cut, lambda: windows.history(df, "k", "t", "id"))


def test_moving_frames(spark, cut):
    df = _table(spark)
    wanted = {"m": lambda w: F.max("v").over(w), "n": lambda w: F.count(F.lit(1)).over(w), "first": lambda w: F.first("id").over(w)}
    for n in (1, 7, 45):
        _same(cut, lambda n=n: windows.rolling(df, "k", ["t", "id"], n, wanted))


def test_asof(spark, cut):
    df = _table(spark)
    left, right = df.where("kind = 'x'"), df.where("kind = 'y'")
    _same(cut, lambda: joins.asof(left, right, "k", "t", {"id": "rid", "v": "rv"}, "id", "id"))


def test_asof_over_parts_without_a_right_row(spark, cut):
    times = [(i, 1, i) for i in range(400)]
    left = spark.createDataFrame(times, "id int, k int, t int")
    right = spark.createDataFrame([(1, 1, 5, None), (2, 1, 5, "b"), (3, 1, 399, "c")], "rid int, k int, t int, x string")
    cut(True)
    found = joins.asof(left, right, "k", "t", {"rid": "m", "x": "x"}, "rid", "id")
    want = [(i, None if i < 5 else 3 if i == 399 else 2) for i in range(400)]
    assert sorted((r["id"], r["m"]) for r in found.collect()) == want


def test_rolling_time(spark, cut):
    df = _table(spark)
    found = _same(cut, lambda: windows.rolling_time(df, "k", "t", 150_000, "v"))
    got = {(r["k"], r["t"]): tuple(r)[2:] for r in found.collect()}
    table = [r for r in df.collect() if r["t"]]
    for (k, t), row in got.items():
        frame = [r["v"] for r in table if r["k"] == k and 0 <= (t - r["t"]).total_seconds() <= 150_000]
        values = [v for v in frame if v is not None]
        assert row == (len(frame), sum(values) if values else None, min(values, default=None), max(values, default=None))
    assert len(got) == len({(r["k"], r["t"]) for r in table})


def test_rolling_time_is_linear(spark):
    """A million points of one key within one frame."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.timestamp_millis(F.col("id")).alias("t"), F.col("id").cast("double").alias("v"))
    found = windows.rolling_time(df, "k", "t", 86_400, "v").agg(F.max("rows"), F.max("total"), F.sum("highest"), F.max("lowest")).first()
    n = 1_000_000
    assert tuple(found) == (n, n * (n - 1) / 2, n * (n - 1) / 2, 0.0)


def test_rows_are_spread(spark):
    """A third of the rows in one group: no part has much more than its share."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("t"), "id")
    seen = []

    def body(found: OrderedRows):
        seen.extend(r["n"] for r in found.df.where("k = 0").groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
        return found.running_sum("n", F.lit(1).cast("long")).df

    out = each_group(df, "k", ["t", "id"], body, rows=500)
    assert sum(seen) == 10_000 and len(seen) >= 18 and max(seen) < 1200
    assert out.where("k = 0").agg(F.count_distinct("n"), F.max("n")).first() == (10_000, 10_000)


def test_running_folds_both_ways(spark, cut):
    df = _table(spark)

    def make():
        def body(found):
            for kind in ("sum", "min", "max"):
                found = found.running(f"{kind}_up", kind, F.col("v")).running(f"{kind}_down", kind, F.col("v"), reverse=True)
            return found.running_last("last", F.col("v")).df

        return each_group(df, "k", ["t", "id"], body)

    _same(cut, make)


@pytest.mark.parametrize("kind", ["double", "int"])
def test_quantiles(spark, cut, kind):
    rng = random.Random(3)
    made = [("hot", rng.choice([5.0, rng.expovariate(1e-3), -rng.random() * 1e9])) for _ in range(1500)]
    made += [("same", 4.0)] * 300 + [("few", 1.0), ("few", 2.0), ("none", None), (None, 7.0)] + [(None, float(i)) for i in range(200)]
    df = spark.createDataFrame(made, "g string, v double").withColumn("v", F.col("v").cast(kind))
    ps = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    values = {}
    for g, v in df.collect():
        values.setdefault(g, []).extend([v] if v is not None else [])
    want = []
    for g, v in values.items():
        v.sort()
        for p in ps:
            at = p * (len(v) - 1)
            low, high = math.floor(at), math.ceil(at)
            want.append((g, p, round(v[low] + (v[high] - v[low]) * (at - low), 6) if v else None))
    for on in (False, True):
        cut(on)
        found = aggregates.quantiles(df, "g", "v", ps)
        assert rows_of(["g", "p", "value"], [(r["g"], r["p"], r["value"] if r["value"] is None else round(r["value"], 6)) for r in found.collect()]) == rows_of(["g", "p", "value"], want)


def test_no_rows(spark, cut):
    cut(True)
    df = _table(spark).limit(0)
    assert rows(windows.history(df, "k", "t", "id")) == []
    assert rows(windows.rolling_time(df, "k", "t", 60, "v")) == []
    assert rows(aggregates.quantiles(df, "k", "v", [0.5])) == []
