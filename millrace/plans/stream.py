"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import scratch_path
from millrace.sources.schemas import SCHEMAS
from millrace.sources.streams import read_batches, read_event_stream, run_stream, stream_settings
from millrace.sources.tables import table
from millrace.streaming import rows, state, windows


def _landed(spark, folder):
    """The events in a folder of their own, for streams that read it in steps."""
    path = scratch_path(spark, "landing")
    table(spark, folder, "events").write.parquet(path)
    return path


def _events(spark, folder):
    return read_event_stream(spark, _landed(spark, folder), SCHEMAS["events"], "ts")


def _stored(df, *columns):
    """Times back as they are stored, without a zone."""
    df = df.select(*columns) if columns else df
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    )


@query("stream_events", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_events(spark, folder):
    events = _events(spark, folder)
    return _stored(run_stream(events, "events"), "event_id", "ts", "user_id", "event_type", "value")


def _days(spark, folder, mode):
    days = windows.tumbling(
        _events(spark, folder), "ts", "1 day", "1 day", F.count(F.lit(1)).alias("rows"),
        F.min("value").alias("lowest"), by=["event_type"],
    )
    return _stored(run_stream(days, "days", mode))


_DAYS = """SELECT date_trunc('day', ts)::TIMESTAMP AS "start", date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end",
       event_type, count(*) AS rows, min(value) AS lowest
FROM events {where} GROUP BY ALL"""


@query(
    "stream_days",
    _DAYS.format(where="WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"),
)
def stream_days(spark, folder):
    """Append mode: only days that the watermark has passed."""
    return _days(spark, folder, "append")


@query("stream_days_complete", _DAYS.format(where=""))
def stream_days_complete(spark, folder):
    return _days(spark, folder, "complete")


@query(
    "stream_sliding",
    """SELECT s AS "start", s + INTERVAL 2 DAY AS "end", count(*) AS rows
FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS s FROM events)
GROUP BY s""",
)
def stream_sliding(spark, folder):
    out = windows.sliding(_events(spark, folder), "ts", "2 days", "1 day", "1 day", F.count(F.lit(1)).alias("rows"))
    return _stored(run_stream(out, "sliding", "complete"))


@query(
    "stream_sessions",
    """WITH m AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM m),
g AS (SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS rows FROM n GROUP BY user_id, s)
SELECT * FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def stream_sessions(spark, folder):
    out = windows.sessions(_events(spark, folder), "user_id", "ts", "6 hours", "1 day", F.count(F.lit(1)).alias("rows"))
    return _stored(run_stream(out, "sessions"))


@query("stream_dedupe", "SELECT event_id, ts, user_id FROM events")
def stream_dedupe(spark, folder):
    """Every event arrives twice."""
    landing = _landed(spark, folder)
    table(spark, folder, "events").write.mode("append").parquet(landing)
    stream = read_event_stream(spark, landing, SCHEMAS["events"], "ts").select("event_id", "ts", "user_id")
    return _stored(run_stream(rows.dedupe(stream, "event_id", "ts", "60 days"), "dedupe"))


@query(
    "stream_match",
    """SELECT v.event_id, v.user_id, v.ts, p.event_id AS p_event_id, p.ts AS p_ts
FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'""",
)
def stream_match(spark, folder):
    kept, landing = ["event_id", "user_id", "ts"], _landed(spark, folder)
    views, purchases = (
        read_event_stream(spark, landing, SCHEMAS["events"], "ts").where(F.col("event_type") == kind).select(*kept)
        for kind in ("view", "purchase")
    )
    pairs = rows.match(views, purchases, "user_id", "ts", "ts", 3600, "1 hour", "p_")
    return _stored(run_stream(pairs.drop("p_user_id"), "match"))


@query(
    "stream_late_rows",
    """SELECT event_id, user_id, ts, event_type,
       event_type = 'error' AND ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 36 HOUR FROM events
                                       WHERE event_type <> 'error') AS late
FROM events""",
)
def stream_late_rows(spark, folder):
    """All error events arrive after the others, in a second run of the stream."""
    landing = scratch_path(spark, "late-landing")
    out, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "late-checkpoint")
    events = table(spark, folder, "events")
    for arrived in ("event_type <> 'error'", "event_type = 'error'"):
        events.where(arrived).write.mode("append").parquet(landing)
        stream = read_event_stream(spark, landing, SCHEMAS["events"], "ts")
        rows.late_rows(stream, "ts", 36 * 3600, out, checkpoint).awaitTermination()
    return _stored(read_batches(spark, f"{out}/rows"), "event_id", "user_id", "ts", "event_type", "late")


@query("stream_running_total", "SELECT user_id AS key, count(*) AS rows, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def stream_running_total(spark, folder):
    """Totals per user, kept under salts and added up."""
    stream = state.salted(_events(spark, folder).select("event_id", "user_id", "value"), "event_id", salts=8)
    out = state.running_state(
        stream, ["user_id", "salt"], state.RunningTotal("value"), "key long, salt int, rows long, total double"
    )
    path = scratch_path(spark, "totals")
    from millrace.sources.streams import write_batches

    with stream_settings(spark):
        query_ = write_batches(out, f"{path}/rows", f"{path}/checkpoint", "update")
    query_.awaitTermination()
    last = read_batches(spark, f"{path}/rows", "update", ["key", "salt"])
    return last.groupBy("key").agg(F.sum("rows").alias("rows"), F.round(F.sum("total"), 6).alias("total"))
