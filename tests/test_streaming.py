from __future__ import annotations

import random
from datetime import datetime

from quire.plans import streams  # noqa: F401
from quire.plans.registry import QUERIES
from quire.streaming import events

SCHEMA = "at_ms long, status string"


def files(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append" if i else "overwrite").parquet(str(path))


def test_counts_over_several_batches(spark, tmp_path):
    files(spark, tmp_path / "in", [(0, "ocr"), (10, "ocr")], [(20, "ocr"), (3_600_000, "failed")], [(3_600_001, "failed")])
    stream = events.window_counts(events.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    events.changelog(stream, str(tmp_path / "out")).awaitTermination()
    got = {tuple(r) for r in events.current(spark, str(tmp_path / "out"), "window_ms", "status").select("window_ms", "status", "n").collect()}
    assert got == {(0, "ocr", 3), (3_600_000, "failed", 2)}


def test_a_second_run_goes_on_where_the_first_stopped(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch in ([(0, "ocr")], [(5, "ocr")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.changelog(events.window_counts(events.event_stream(spark, str(tmp_path / "in"))), out).awaitTermination()
    assert [tuple(r) for r in events.current(spark, out, "window_ms", "status").select("window_ms", "status", "n").collect()] == [(0, "ocr", 2)]


def test_empty_stream_has_a_changelog(spark, tmp_path):
    files(spark, tmp_path / "in", [])
    events.changelog(events.window_counts(events.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out")).awaitTermination()
    assert events.current(spark, str(tmp_path / "out"), "window_ms", "status").count() == 0


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    day = 86_400_000
    out = str(tmp_path / "out")
    for batch in ([(10 * day, "ocr")], [(10 * day + 1, "ocr")], [(day, "ocr"), (10 * day + 2, "ocr")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.changelog(events.window_counts(events.event_stream(spark, str(tmp_path / "in"))), out).awaitTermination()
    assert {(r.window_ms, r.n) for r in events.current(spark, out, "window_ms", "status").collect()} == {(10 * day, 3)}


def test_the_query_counts_events_in_any_order_of_files(spark, tmp_path):
    days = datetime(2024, 1, 1), datetime(2024, 1, 11)
    n = 2 * events.FILES_PER_TRIGGER + 1  # three micro-batches: the watermark of the first drops from the third on
    for i in range(n):
        rows = [(2 * i + k, day, 1, "click", '{"k": 1}') for k, day in enumerate(days)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["st05_window_counts"](spark, str(tmp_path)).select("window_ms", "status", "n").collect())
    assert got == [(1_704_067_200_000, "ocr", n), (1_704_931_200_000, "ocr", n)]


def throttled_by_hand(rows, faithful):
    last, out = {}, []
    for event, job, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        if job not in last or at - last[job] >= 50 or not faithful and status in ("completed", "failed"):
            out.append(event)
            last[job] = at
    return sorted(out)


def test_throttle_over_micro_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), i * 9 + rng.randrange(5), rng.choice(["ocr", "ocr", "ocr", "completed"])) for i in range(120)]
    for at in range(0, 120, 30):
        spark.createDataFrame(rows[at : at + 30], "event_id long, job_id long, at_ms long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for faithful in (False, True):
        out = str(tmp_path / f"out{faithful}")
        stream = events.throttled(events.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1), faithful=faithful)
        events.changelog(stream, out, mode="append").awaitTermination()
        got = sorted(r.event_id for r in spark.read.parquet(f"{out}/changes").collect())
        assert got == throttled_by_hand(rows, faithful) and len(got) < 120


def test_snapshots_are_merged_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "queued", 0), ("b", "running", 10), ("new", "pending", 0)], "id string, status string, percent int")
    for batch in ([(1, "a", "running", 5), (1, "b", "running", 20)], [(2, "a", "running", 50), (3, "a", "completed", 100)]):
        spark.createDataFrame(batch, "snapshot long, id string, status string, percent int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    events.reconcile(events.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1), rows, out).awaitTermination()
    assert {tuple(r) for r in events.newest_rows(spark, out).collect()} == {("a", "completed", 100), ("new", "pending", 0)}
