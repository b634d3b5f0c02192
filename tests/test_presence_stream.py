"""Starts without a partner, told by timers: equal to the batch job over closed ranges, whatever stops in between."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import presence
from tidemill.sources.snapshots import Snapshots
from tidemill.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
BEFORE, AFTER, LATE = 30, 300, 60


@pytest.fixture
def rows():
    rng = np.random.default_rng(8)
    out = [(f"k{int(k)}", T0 + dt.timedelta(seconds=float(s)), bool(b)) for k, s, b in zip(rng.integers(0, 6, 260), np.sort(rng.uniform(0, 20_000, 260)), rng.random(260) < 0.5, strict=True)]
    busy = [("busy", T0 + dt.timedelta(seconds=20.0 * i), i % 2 == 0) for i in range(0, 200)]
    edges = [("edge", T0 + dt.timedelta(seconds=s), b) for s, b in ((5000, True), (5300, False), (9000, True), (9301, False), (12000, True), (11970, False), (15000, True), (14969, False), (5000, True))]
    return sorted([*out, *busy, *edges, (None, T0, True)], key=lambda r: r[1])


def told(spark, folder, checkpoint, path):
    s = spark.readStream.schema("key string, ts timestamp, is_start boolean").parquet(f"{folder}/in").repartition(2)
    out = jobs.presence_stream(s.where("is_start"), s.where("not is_start"), "key", BEFORE, AFTER, LATE)
    jobs.versioned_sink(out, path, ["key", "ts"], checkpoint).awaitTermination()
    return sorted((r["key"], r["ts"]) for r in Snapshots(spark, path).read().collect())


def test_presence_equals_the_batch_job_after_a_restart(spark, rows, tmp_path):
    with jobs.timers(spark):
        kind = "key string, ts timestamp, is_start boolean"
        every = spark.createDataFrame(rows, kind)

        def closed(until):
            """The batch job's rows whose ranges the watermark has passed."""
            end = max(r[1] for r in rows[:until]) - dt.timedelta(seconds=LATE)
            part = spark.createDataFrame(rows[:until], kind)
            out = presence.absent_partner(part.where("is_start"), part.where("not is_start"), "key", BEFORE, AFTER, 0, "2025-01-01 00:00:00")
            return sorted((r["key"], r["ts"]) for r in out.where(F.col("ts") + F.expr(f"INTERVAL {AFTER} SECONDS") < F.lit(end)).collect())

        half = len(rows) // 2
        spark.createDataFrame(rows[:half], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        first = told(spark, tmp_path, f"{tmp_path}/check", f"file://{tmp_path}/told")
        assert first == closed(half) and first
        spark.createDataFrame(rows[half:], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        both = told(spark, tmp_path, f"{tmp_path}/check", f"file://{tmp_path}/told")
        assert both == closed(len(rows)) and len(both) > len(first)
        # a checkpoint that is lost tells all again; the table of what was told takes none of it twice
        assert told(spark, tmp_path, f"{tmp_path}/other", f"file://{tmp_path}/told") == both
        assert every.count() == len(rows)
