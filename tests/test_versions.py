"""Tables of versions: old or new is seen, never a mixture, and nothing is deleted."""

import pytest
from compare import rows

from millrace.operators import merge
from millrace.sources import versions

SCHEMA = "k int, v string, p string"
ODD = ["a b/c", "x=y", "50%", 'q"u\'o', "é{[]}^", "a:b?#*\\", "", None, "tab\tnew\nline", "%2F"]


def test_partitions_move_empty_and_come_back(spark, tmp_path):
    path = str(tmp_path / "t")
    start = [(i, f"v{i}", p) for i, p in enumerate(ODD)]
    assert versions.last_version(spark, path) is None
    versions.write_version(spark.createDataFrame(start, SCHEMA), path, "p")
    want = {k: (k, v, p or None) for k, v, p in start}
    assert rows(versions.read_versioned(spark, path, SCHEMA)) == rows(spark.createDataFrame(list(want.values()), SCHEMA))
    files = {f for f in tmp_path.rglob("*")}
    for k in range(len(ODD)):
        # One by one every partition is emptied; the rows gather in one.
        change = spark.createDataFrame([(k, "new", "all", 1)], SCHEMA + ", version int")
        number = merge.upsert_versioned(path, SCHEMA, change, "k", "version", "p")
        want[k] = (k, "new", "all")
        assert number == k + 1
        assert rows(versions.read_versioned(spark, path, SCHEMA)) == rows(spark.createDataFrame(list(want.values()), SCHEMA))
    assert files <= {f for f in tmp_path.rglob("*")}
    first = [(k, v, p or None) for k, v, p in start]
    assert rows(versions.read_versioned(spark, path, SCHEMA, 0)) == rows(spark.createDataFrame(first, SCHEMA))


@pytest.mark.parametrize("step", ["data", "pointer"])
def test_a_stop_between_steps_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    versions.write_version(spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], SCHEMA), path, "p")
    old = rows(versions.read_versioned(spark, path, SCHEMA))
    change = spark.createDataFrame([(1, "x", "B", 1)], SCHEMA + ", version int")

    class Stop(Exception):
        pass

    def stopped(df, data, by):
        if step == "pointer":
            real(df, data, by)
        raise Stop

    with monkeypatch.context() as patched:
        real = versions.write_partitioned
        patched.setattr(versions, "write_partitioned", stopped)
        with pytest.raises(Stop):
            merge.upsert_versioned(path, SCHEMA, change, "k", "version", "p")
    assert rows(versions.read_versioned(spark, path, SCHEMA)) == old
    # A version that was begun and has no mark of completion is not read either.
    (tmp_path / "t" / "versions" / "version=7").mkdir()
    assert rows(versions.read_versioned(spark, path, SCHEMA)) == old
    assert merge.upsert_versioned(path, SCHEMA, change, "k", "version", "p") == 1
    assert rows(versions.read_versioned(spark, path, SCHEMA)) == [(1, "x", "B"), (2, "b", "B")]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", "A")], SCHEMA)
    versions.write_version(df, path, "p")
    with pytest.raises(ValueError):
        versions.write_version(df, path, "p")
    versions.write_version(df, path, "p", [], 0)
    with pytest.raises(ValueError, match="exists"):
        versions.write_version(df, path, "p", [], 0)
    empty = versions.write_version(df.limit(0), path, "p", [], 1)
    assert empty == 2 and rows(versions.read_versioned(spark, path, SCHEMA)) == []
