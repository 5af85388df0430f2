"""Streaming admission over several micro-batches equals the batch replay:
the keyed state carries the admitted timestamps across batches."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SMALL
from veilframe.functions.timeutil import epoch_millis, utc_instant
from veilframe.operators import ratelimit as R
from veilframe.sources.tables import load
from veilframe.streaming import admission as SA
from veilframe.streaming.runner import run_available_now


def test_admission_stream_across_batches(spark):
    events = load(spark, SMALL, "events").select(
        F.col("event_type").alias("rl_key"), epoch_millis(F.col("ts")).alias("t"), "event_id",
        utc_instant(F.col("ts")).alias("event_time"))
    d = tempfile.mkdtemp(prefix="veilframe-stream-test-")
    bounds = events.agg(F.min("t"), F.max("t")).first()
    lo, hi = bounds[0], bounds[1] + 1
    step = (hi - lo) // 4 + 1
    for i in range(4):  # four files in time order, written one after the other
        part = events.where((F.col("t") >= lo + i * step) & (F.col("t") < lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, f"part{i}"))
        time.sleep(1.1)
    files = sorted(os.path.join(root, f) for root, _, fs in os.walk(d) for f in fs if f.endswith(".parquet"))
    flat = tempfile.mkdtemp(prefix="veilframe-stream-src-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:02d}.parquet"))
        os.utime(os.path.join(flat, f"{i:02d}.parquet"), (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    out = run_available_now(SA.admit_stream(stream, 2, R.WINDOW_MS), "admission_multi_batch")
    got = {r["event_id"]: (r["admitted"], r["current"]) for r in out.collect()}
    batch = R.admit(events.drop("event_time"), "rl_key", "t", "event_id", 2)
    want = {r["event_id"]: (r["admitted"], r["current"]) for r in batch.collect()}
    assert len(files) == 4 and got == want


def _files(spark, batches, schema):
    """A file stream that gives one of ``batches`` per trigger."""
    d, flat = tempfile.mkdtemp(prefix="veilframe-batches-"), tempfile.mkdtemp(prefix="veilframe-batches-src-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, str(i)))
        src = [f for f in os.listdir(os.path.join(d, str(i))) if f.endswith(".parquet")][0]
        os.link(os.path.join(d, str(i), src), os.path.join(flat, f"{i:02d}.parquet"))
        os.utime(os.path.join(flat, f"{i:02d}.parquet"), (3_000_000 + i, 3_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)


def test_stream_limits_by_key_and_late_rows(spark):
    """Own limits (0 among them), and rows that come after newer ones: decided, marked, none dropped."""
    schema = "rl_key string, t long, event_id long, cap int"
    caps = {"none": 0, "one": 1, "three": 3}
    batches, i = [], 0
    for start in (0, 1500, 3000):
        rows = []
        for key, cap in caps.items():
            for k in range(8):
                i += 1
                rows.append((key, start + k * 150, i, cap))
        batches.append(rows)
    late = [(key, 100, 900 + n, cap) for n, (key, cap) in enumerate(caps.items())]
    batches.append(late)
    out = run_available_now(SA.admit_stream(_files(spark, batches, schema), "cap", 1000), "limits_by_key").collect()
    got = {r["event_id"]: (r["admitted"], r["current"], r["retry_after_ms"]) for r in out}
    assert len(got) == len(out) == 24 * 3 + 3
    from test_ratelimit import _brute
    for key, cap in caps.items():
        times = [(key, t, n) for rows in batches[:3] for k, t, n, _ in rows if k == key]
        if cap:
            want = _brute(times, cap, 1000)
            assert {n: got[n] for _, _, n in times} == want
            newest = max(t for _, t, n in times if want[n][0])
            held = sorted(t for _, t, n in times if want[n][0] and t > newest - 1000)
            n = next(r[2] for r in late if r[0] == key)
            assert got[n] == ((False, cap, 1000 - (newest - held[0])) if len(held) >= cap else (True, len(held) + 1, 0))
        else:
            assert all(got[n] == (False, 0, 0) for _, _, n in times)
    side = {r["event_id"] for r in out if r["late"]}
    assert side == {r[2] for r in late if r[0] != "none"}  # nothing was ever admitted for "none", so nothing is newer


def test_window_counts_with_a_row_behind_the_watermark(spark):
    from datetime import datetime

    schema = "ts timestamp, event_type string"
    d = tempfile.mkdtemp(prefix="veilframe-late-test-")
    first = [(datetime(2024, 1, 1, h, 5), "view") for h in range(0, 6)]
    second = [(datetime(2024, 1, 1, 1, 30), "view"),  # 4 h behind the watermark: dropped
              (datetime(2024, 1, 1, 6, 10), "view")]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, f"b{i}"))
    flat = tempfile.mkdtemp(prefix="veilframe-late-src-")
    for i, name in enumerate(("b0", "b1")):
        src = [f for f in os.listdir(os.path.join(d, name)) if f.endswith(".parquet")][0]
        dst = os.path.join(flat, f"{i:02d}.parquet")
        os.link(os.path.join(d, name, src), dst)
        os.utime(dst, (2_000_000 + i, 2_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)
    out = run_available_now(SA.request_counts_stream(stream, "ts", "1 hour", "10 minutes", ["event_type"]), "late")
    rows = out.collect()
    starts = [r["window"]["start"].hour for r in rows]
    counts = dict(zip(starts, (r["n"] for r in rows)))
    # append mode: each closed window is emitted exactly once; on-time rows are
    # all counted.  The row 4 h behind the watermark is either dropped or, as
    # Spark allows, folded into its window if that window is still in state
    # (no empty batch ran between the two files).
    assert len(starts) == len(set(starts))
    assert all(counts.get(h) == 1 for h in (0, 2, 3, 4, 5))
    assert counts.get(1) in (1, 2)


def test_a_run_stopped_before_its_commit_is_resumed(spark, tmp_path):
    """Stopped after batch 1 was written but before it was committed: the next run writes it again in
    its place, loses nothing and duplicates nothing."""
    import pytest
    from pyspark.errors import StreamingQueryException

    from veilframe.streaming.runner import append_idempotent

    batches = [[(f"b{i}", i * 10 + k) for k in range(5)] for i in range(4)]
    path = str(tmp_path / "table")
    flat = _files(spark, batches, "name string, n long")

    def stop(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        append_idempotent(flat, path, ("name",), after_batch=stop)
    assert spark.read.parquet(path).count() == 10  # batch 1 is there, uncommitted
    seen = []
    append_idempotent(flat, path, ("name",), after_batch=seen.append)
    assert seen == [1, 2, 3]
    append_idempotent(flat, path, ("name",))  # nothing new
    rows = [(r["name"], r["n"]) for r in spark.read.parquet(path).collect()]
    assert sorted(rows) == sorted(r for b in batches for r in b)
