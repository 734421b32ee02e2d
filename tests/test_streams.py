"""Streams that are stopped, run again, fed in steps or late: the same rows, none twice."""

import datetime as dt

import pytest
from compare import rows
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.sources import streams
from millrace.sources.streams import read_batches, read_event_stream, run_stream, write_batches
from millrace.streaming import rows as stream_rows
from millrace.streaming import state, windows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


def _events(spark, ids, minutes=10):
    start = dt.datetime(2024, 1, 1)
    made = [(i, start + dt.timedelta(minutes=minutes * i), i % 3) for i in ids]
    return spark.createDataFrame(made, SCHEMA)


def _land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    for k in range(3):
        _land(_events(spark, range(100 * k, 100 * k + 100)), landing)
        stream = read_event_stream(spark, landing, SCHEMA, "ts")
        write_batches(stream, out, checkpoint).awaitTermination()
        found = read_batches(spark, out)
        assert found.count() == found.select("event_id").distinct().count() == 100 * (k + 1)
    assert sorted(p.name for p in (tmp_path / "out").glob("batch_id=*")) == ["batch_id=0", "batch_id=1", "batch_id=2"]
    with pytest.raises(ValueError):
        write_batches(read_event_stream(spark, landing, SCHEMA, "ts"), out, str(tmp_path / "another"))


def test_a_batch_that_failed_after_its_write_is_written_once(spark, tmp_path, monkeypatch):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    _land(_events(spark, range(50)), landing)
    writer = type(spark.range(1).write)
    real, calls = writer.parquet, []

    def fails_once(self, path, *args, **more):
        real(self, path, *args, **more)
        if "batch_id=" in path:
            calls.append(path)
            if len(calls) == 1:
                raise RuntimeError("stopped after the write")

    monkeypatch.setattr(writer, "parquet", fails_once)
    with pytest.raises(StreamingQueryException):
        write_batches(read_event_stream(spark, landing, SCHEMA, "ts"), out, checkpoint).awaitTermination()
    assert read_batches(spark, out).count() == 50
    write_batches(read_event_stream(spark, landing, SCHEMA, "ts"), out, checkpoint).awaitTermination()
    assert len(calls) == 2 and calls[0] == calls[1]
    assert rows(read_batches(spark, out), "event_id") == rows(_events(spark, range(50)), "event_id")


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_windows_do_not_depend_on_the_files(spark, tmp_path, mode):
    """One file or many, in one batch or several: the same closed windows."""
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    events = _events(spark, range(300))
    _land(events, whole)
    for k in range(6):
        _land(events.where((F.col("event_id") >= 50 * k) & (F.col("event_id") < 50 * k + 50)), cut)
    answers = []
    for folder, files in ((whole, None), (cut, None), (cut, 1)):
        stream = read_event_stream(spark, folder, SCHEMA, "ts", files)
        hours = windows.tumbling(stream, "ts", "1 hour", "1 hour", F.count(F.lit(1)).alias("n"), by=["user_id"])
        answers.append(rows(run_stream(hours, "hours", mode)))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 100


def test_repeats_within_the_delay_go_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _land(_events(spark, range(60)), landing)
    _land(_events(spark, range(30, 60)), landing)
    stream = read_event_stream(spark, landing, SCHEMA, "ts", 1)
    found = run_stream(stream_rows.dedupe(stream, "event_id", "ts", "1 day"), "once")
    assert rows(found, "event_id") == rows(_events(spark, range(60)), "event_id")


def test_late_rows_are_kept_and_marked(spark, tmp_path):
    """Rows an hour behind the latest before their batch are late; a restart remembers it."""
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    for ids in (range(100, 130), range(90, 100), range(124, 160)):
        _land(_events(spark, ids), landing)
        stream = read_event_stream(spark, landing, SCHEMA, "ts")
        stream_rows.late_rows(stream, "ts", 3600, out, checkpoint).awaitTermination()
    found = read_batches(spark, f"{out}/rows").select("event_id", "late").collect()
    late = sorted(r["event_id"] for r in found if r["late"])
    assert len(found) == 30 + 10 + 36 and late == list(range(90, 100))


def test_settings_are_put_back(spark):
    before = {n: spark.conf.get(n, None) for n in streams.STREAM_SETTINGS}
    with pytest.raises(RuntimeError), streams.stream_settings(spark):
        assert spark.conf.get(next(iter(before))) == next(iter(streams.STREAM_SETTINGS.values()))
        raise RuntimeError
    assert {n: spark.conf.get(n, None) for n in before} == before


def test_a_total_asks_for_its_state_once():
    """A key is rows in, one call for its state, one to keep it, and a row out: no frames."""

    class Kept:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    total = state.RunningTotal("v")
    total.state = Kept()
    first = list(total.handleInputRows((7, 1), iter([Row(v=1.5), Row(v=None), Row(v=float("nan"))]), None))
    second = list(total.handleInputRows((7, 1), iter([Row(v=2.0)]), None))
    assert first == [Row(key=7, salt=1, rows=3, total=1.5)] and second == [Row(key=7, salt=1, rows=4, total=3.5)]
    assert Kept.calls == ["get", "update"] * 2


def test_totals_go_on_over_batches(spark, tmp_path):
    """Also of the null key, whose rows were once added to other keys."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    key = F.when(F.col("id") % 11 > 2, F.col("id") % 7)
    made = spark.range(300).select("id", key.alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("v"))
    for k in range(3):
        _land(made.where(F.col("id") % 3 == k), landing)
    stream = state.salted(spark.readStream.schema("id long, k long, v double").option("maxFilesPerTrigger", 1).parquet(landing), "id")
    with streams.stream_settings(spark):
        totals = state.running_state(stream, ["k", "salt"], state.RunningTotal("v"), "key long, salt int, rows long, total double")
        begun = write_batches(totals, out, str(tmp_path / "checkpoint"), "update")
    begun.awaitTermination()
    found = read_batches(spark, out, "update", ["key", "salt"]).groupBy("key").agg(F.sum("rows"), F.sum("total"))
    assert rows(found) == rows(made.groupBy("k").agg(F.count(F.lit(1)), F.sum("v")))
