"""Nulls, names, rules, outer joins and upserts."""

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.functions.copies import numbered_copies
from millrace.operators import aggregates, joins, merge, quality, sets, windows
from millrace.sources.tables import read_table, write_partitioned


def test_upsert_moves_keys_between_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, p string"
    target = [(1, "a", "A"), (2, "b", "B"), (3, "c", "A"), (None, "n", "B")]
    write_partitioned(spark.createDataFrame(target, schema), path, "p")
    changes = [(1, "x", "C", 1), (None, "m", "C", 1)]
    changes = spark.createDataFrame(changes, schema + ", version int")
    for _ in range(2):
        merge.upsert_partitions(path, schema, changes, "k", "version", "p")
        assert rows(read_table(spark, path, schema)) == [(None, "m", "C"), (1, "x", "C"), (2, "b", "B"), (3, "c", "A")]


def test_upsert_deletes_nothing(spark, tmp_path, monkeypatch):
    """A partition that would be emptied is refused, and no file anywhere goes."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "bystander").write_text("kept")
    path, schema = str(tmp_path / "t"), "k int, v string, p string"
    write_partitioned(spark.createDataFrame([(1, "a", "A"), (2, "b", "a b/c")], schema), path, "p")
    before = {f for f in tmp_path.rglob("*")}
    changes = spark.createDataFrame([(2, "x", "A", 1)], schema + ", version int")
    with pytest.raises(ValueError):
        merge.upsert_partitions(path, schema, changes, "k", "version", "p")
    assert before <= {f for f in tmp_path.rglob("*")}


def test_upsert_treats_a_null_key_as_a_key(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    changes = spark.createDataFrame([(None, "m", 1)], "k int, v string, version int")
    once = merge.upsert(target, changes, "k", "version")
    assert rows(once) == rows(merge.upsert(once, changes, "k", "version")) == [(None, "m"), (1, "a")]


def test_conform_matches_names_as_the_session_does(spark):
    df = spark.createDataFrame([(1,)], "O_KEY int")
    assert rows(quality.conform(df, "o_key long")) == [(1,)]
    twice = df.select(F.col("O_KEY"), F.col("O_KEY").alias("o_key"))
    with pytest.raises(ValueError):
        quality.conform(twice, "o_key long")


def test_blank_payloads_are_corrupt(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, '{"k":3}'), (4, None), (5, "{")], "id int, p string")
    found = quality.parse_payload(df, "p", "k int")
    assert rows(found, "id", "k", "_corrupt") == [
        (1, None, ""), (2, None, "  "), (3, 3, None), (4, None, None), (5, None, "{"),
    ]


def test_no_rules(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert quality.accepted(df, {}).count() == 1 and quality.quarantined(df, {}).count() == 0
    assert quality.validate(df, {}).first()["_errors"] == []


def test_null_keys_and_times(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, None, 5), (3, 1, None), (4, 2, 5)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 1, 2)], "rid int, k int, t int")
    found = joins.asof(left, right, "k", "t", {"rid": "m"}, "rid", "id")
    assert sorted((r["id"], r["m"]) for r in found.collect()) == [(1, 3), (2, None), (3, None), (4, None)]
    times = spark.sql(
        "select 1 k, id, cast(t as timestamp_ntz) t, 1L v from values (1, null), (2, '2024-01-01 00:00:00'),"
        " (3, '2024-01-01 00:00:10') x(id, t)"
    )
    assert [r["rows"] for r in windows.sessionise(times, "k", "t", "id", 60).orderBy("session").collect()] == [1, 2]
    rolled = windows.rolling_time(times, "k", "t", 60, "v").orderBy("t").collect()
    assert [(r["rows"], r["total"]) for r in rolled] == [(1, 1), (2, 2)]
    empty = spark.createDataFrame([(1, None), (2, 4)], "g int, v int")
    found = aggregates.quantiles(empty, "g", "v", [0.5]).collect()
    assert sorted((r["g"], r["value"]) for r in found) == [(1, None), (2, 4.0)]


def test_outer_joins_are_inner_and_anti(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "a int, av string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r"), (4, "s")], "b int, bv string")
    for how in ("left", "full"):
        want = a.join(b, a["a"] == b["b"], how)
        assert sorted(map(str, joins.join_facts(a, b, {"a": "b"}, how).collect())) == sorted(map(str, want.collect()))


def test_profile_compares_in_the_type_of_the_column(spark):
    df = spark.sql(
        "select * from values (9, 9.5D, '9', timestamp_ntz '2024-01-09 00:00:00', array(9), map('a', 1), null),"
        " (10, 10.5D, '10', timestamp_ntz '2023-12-31 00:00:00', array(10, 1), map('a', 1), null),"
        " (null, null, null, null, null, null, null) t(i, d, s, t, a, m, n)"
    ).withColumn("n", F.lit(None).cast("int"))
    found = {r["column"]: tuple(r)[1:] for r in quality.profile(df).collect()}
    assert found["i"] == (3, 1, 2, "9", "10") and found["d"] == (3, 1, 2, "9.5", "10.5")
    assert found["s"] == (3, 1, 2, "10", "9")
    assert found["t"] == (3, 1, 2, "2023-12-31 00:00:00", "2024-01-09 00:00:00")
    assert found["a"] == (3, 1, 2, '{"a":[9]}', '{"a":[10,1]}')
    assert found["m"] == (3, 1, 1, None, None) and found["n"] == (3, 3, 0, None, None)
    clash = df.select(F.col("i").alias("column"), F.col("i").alias("n"), F.col("i").alias("low0"))
    assert rows(quality.profile(clash), "column", "lowest") == [("column", "9"), ("low0", "9"), ("n", "9")]


def test_broken_payloads_keep_their_text(spark):
    df = spark.createDataFrame([(1, '{"k":3'), (2, '{"k":"x"}'), (3, '{"k":3}')], "id int, p string")
    assert rows(quality.parse_payload(df, "p", "k int"), "id", "k", "_corrupt") == [
        (1, None, '{"k":3'), (2, None, '{"k":"x"}'), (3, 3, None),
    ]


def test_copies_of_a_frequent_row_are_spread(spark, monkeypatch):
    a = spark.createDataFrame([(1, "x")] * 40 + [(2, "y")] * 3 + [(None, None)] * 2, "k int, v string")
    b = spark.createDataFrame([(1, "x")] * 10 + [(2, "y")] * 5, "k int, v string")
    counted = [((1, "x"), 30), ((None, None), 2)]
    assert sorted(map(str, sets.minus(a, b, True).collect())) == sorted(str(r) for r in a.exceptAll(b).collect())
    assert sets.minus(a, b, True).count() == sum(n for _, n in counted)
    big = spark.createDataFrame([(1, 1_000_000), (2, 3), (3, 0), (4, -1)], "k int, n long")
    out = numbered_copies(big, "n", "i", chunk=1000)
    assert rows(out.groupBy("k").agg(F.count_distinct("i"), F.min("i"), F.max("i"))) == [(1, 1_000_000, 0, 999_999), (2, 3, 0, 2)]
    per_task = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r["n"] for r in per_task) < 700_000


def test_large_k_is_ranked_in_parts(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("v"), "id", F.lit("x").alias("_of"))
    order = [F.desc("v"), "id"]
    want = rows(windows.top_k(df, "g", order, 700))
    monkeypatch.setattr(windows, "LARGE_K", 10)
    found = windows.top_k(df, "g", order, 700)
    assert found.columns == df.columns and rows(found) == want and len(want) == 1400
    assert rows(windows.top_k(df.where("id < 0"), "g", order, 700)) == []


def test_estimates_stay_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50_000).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("v"))
    for r in aggregates.distinct_estimate(df, "g", "k", 0.02).collect():
        assert abs(r["distinct_values"] - 25_000) < 4 * 0.02 * 25_000
    ps = [0.01, 0.5, 0.99]
    exact = {g: sorted(r["v"] for r in df.where(F.col("g") == g).select("v").collect()) for g in (0, 1)}
    for r in aggregates.quantiles_estimate(df, "g", "v", ps, 1000).collect():
        values = exact[r["g"]]
        place = sum(v <= r["value"] for v in values) / len(values)
        assert abs(place - r["p"]) <= 2 / 1000
