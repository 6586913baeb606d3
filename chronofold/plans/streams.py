"""Queries of the streaming operators, each driven once over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .ledger import _CHAIN


def _events(spark, d):
    return streams.read(spark, f"{d.rstrip('/')}/events.parquet", "ts")


def stream_idempotency(spark, d):
    return streams.run_once(streams.first_per_key(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"))


def stream_windows(spark, d):
    return streams.run_once(streams.counts_per_window(_events(spark, d), "ts", "1 day", ["event_type"]), "complete")


def stream_sessions(spark, d):
    return streams.run_once(streams.sessions(_events(spark, d), "ts", "6 hours", ["user_id"]), "complete")


def stream_workflow(spark, d):
    return streams.run_once(streams.transitions(streams.read(spark, f"{d.rstrip('/')}/machine_history.parquet", "created_at")))


def stream_timers(spark, d):
    events = _events(spark, d).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    return streams.run_once(streams.expiries(events, "ts", 86_400, "key", "value > 1000"))


QUERIES = {f.__name__: f for f in (stream_idempotency, stream_windows, stream_sessions, stream_workflow, stream_timers)}
ORACLES = {
    "stream_idempotency": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": "SELECT epoch_us(date_trunc('day', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT epoch_us(min(ts)) AS from_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS to_us, user_id, count(*) AS n FROM s GROUP BY user_id, no""",
    "stream_workflow": _CHAIN,
    # A hold ends a day after its first event unless an event with done came; it fires when the
    # watermark, an hour behind the latest event, has passed it.
    "stream_timers": """
SELECT user_id || '/' || event_type AS key, epoch_us(min(ts)) + 86400000000 AS due_us FROM events GROUP BY user_id, event_type
HAVING NOT bool_or(value > 1000) AND due_us // 1000 + 1 < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
}
