"""Streaming queries: whole runs over the events, with what the batch forms give as oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.adapters import EVENTS_SQL, as_job_events
from quire.operators import queue
from quire.plans.registry import query
from quire.sources.scratch import scratch_path
from quire.streaming import events


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The table may be one file or a folder; a stream takes a file only by a pattern."""
    return as_job_events(events.event_stream(spark, f"{d}/{{events.parquet}}"))


def _run(spark: SparkSession, stream: DataFrame, name: str, *keys: str) -> DataFrame:
    path = scratch_path(spark, name)
    events.changelog(stream, path).awaitTermination()
    return events.current(spark, path, *keys)


@query("st01_progress_stream", f"WITH {EVENTS_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_ms DESC, event_id DESC) = 1) SELECT job_id, status, CASE WHEN status = 'completed' THEN 100 ELSE current_page END AS progress FROM l")
def _(spark, d):
    stream = _events(spark, d)
    progress = F.when(F.col("status") == "completed", 100).otherwise(F.col("current_page"))
    return _run(spark, queue.latest(stream, "job_id", "at_ms", "event_id").select("job_id", "status", progress.alias("progress")), "progress", "job_id")


@query("st05_window_counts", f"WITH {EVENTS_SQL} SELECT CAST(at_ms // 3600000 * 3600000 AS BIGINT) AS window_ms, status, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    return _run(spark, events.window_counts(_events(spark, d), delay=None), "counts", "window_ms", "status")
