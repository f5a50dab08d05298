"""Progress events as streams: a bounded source, a changelog sink that survives retries, windowed counts.

The operators of :mod:`quire.operators.queue` that only group by key serve streams as they are; what
is here is the edge around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Files a micro-batch takes at most: the bound of the reader's queue.
FILES_PER_TRIGGER = 4
#: What the engine tells; channels are pipelineProgress, queueState, jobProgress, jobFinished and historyUpdated.
ENGINE_EVENTS = "channel string, at_ms long, job_id string, payload string"
#: Milliseconds that must lie between two events of a job, and statuses that always pass.
INTERVAL, TERMINAL = 50, ("completed", "failed")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """The events under ``path`` as a stream, a few files at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def changelog(stream: DataFrame, path: str, mode: str = "update") -> StreamingQuery:
    """Starts writing what changes in each micro-batch below ``path`` until no input is left.

    A batch that runs again after a failure overwrites its own version, so each counts once. Version -1
    is empty: a stream without rows has a readable changelog too.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/changes/version=-1")

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/version={version}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest version of each key in a changelog."""
    changes = spark.read.parquet(f"{path}/changes")
    rest = [c for c in changes.columns if c not in (*keys, "version")]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def window_counts(events: DataFrame, window: str = "1 hour", delay: str | None = "1 day") -> DataFrame:
    """window_ms, status, n of (at_ms, status); an event later than ``delay`` behind the newest is dropped.

    Without a delay every event counts, in whatever order files bring them; a count is then kept for each window and status.
    """
    timed = events.withColumn("at", F.timestamp_millis("at_ms"))
    if delay is not None:
        timed = timed.withWatermark("at", delay)
    counts = timed.groupBy(F.window("at", window).alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.unix_millis("w.start").alias("window_ms"), "status", "n")


def throttled(events: DataFrame, interval: int = INTERVAL, faithful: bool = False) -> DataFrame:
    """A stream of (event_id, job_id, at_ms, status) without those too soon after the last of their job that passed.

    The time of the last one is kept a job across micro-batches; within one, events go by time and id. Terminal
    statuses always pass, unless ``faithful`` to writers that drop those too.
    """

    def rule(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, kept = pd.concat(list(frames)).sort_values(["at_ms", "event_id"]), []
        for at, status in zip(rows["at_ms"].tolist(), rows["status"].tolist(), strict=True):
            passes = last is None or at - last >= interval or not faithful and status in TERMINAL
            last = at if passes else last
            kept.append(passes)
        state.update((last,))
        yield rows[kept]

    columns = "event_id long, job_id long, at_ms long, status string"
    return events.select("event_id", "job_id", "at_ms", "status").groupBy("job_id").applyInPandasWithState(rule, columns, "last long", "append", "NoTimeout")


def reconciled(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows (id, status, percent, ...) after a snapshot (id, status, percent) of the queue.

    Rows that the snapshot no longer has go, unless they were never queued (status pending); the others take its values.
    """
    theirs = snapshot.select("id", F.col("status").alias("__status"), F.col("percent").alias("__percent"))
    both = rows.join(theirs, "id", "left").filter(F.col("__status").isNotNull() | (F.col("status") == "pending"))
    return both.withColumn("status", F.coalesce("__status", "status")).withColumn("percent", F.coalesce("__percent", "percent")).select(*rows.columns)


def reconcile(snapshots: DataFrame, rows: DataFrame, path: str) -> StreamingQuery:
    """Starts merging a stream of (snapshot, id, status, percent) into ``rows``, one version below ``path`` a micro-batch.

    Only the newest snapshot of a micro-batch counts, as each holds the whole queue. Version -1 is ``rows``; a
    batch that runs again after a failure starts from the version before its own.
    """
    spark = snapshots.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/rows/version=-1")

    def merge(batch: DataFrame, version: int) -> None:
        newest = batch.agg(F.max("snapshot")).first()[0]
        before = spark.read.schema(rows.schema).parquet(f"{path}/rows/version={version - 1}")
        after = before if newest is None else reconciled(before, batch.filter(F.col("snapshot") == newest))
        after.write.mode("overwrite").parquet(f"{path}/rows/version={version}")

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows after the last micro-batch of :func:`reconcile`."""
    every = spark.read.parquet(f"{path}/rows")
    return every.filter(F.col("version") == every.agg(F.max("version")).first()[0]).drop("version")
