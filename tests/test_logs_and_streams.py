"""Sinks, scans, the worker view and the streaming jobs on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.streaming import jobs as W


def records(spark):
    rows = [(1, dt.datetime(2026, 6, 14, 10), " hello ", 1, "gpt-4o-mini", 0.001, 0.3, None, False),
            (2, dt.datetime(2026, 6, 15, 11), "hello", 2, "claude-3-haiku", 0.002, 0.2, 4.0, True),
            (3, None, "x", 3, "gpt-4o", 0.01, 2.0, 4.5, False),
            (4, dt.datetime(2026, 6, 15, 12), "bad", None, "gpt-4o", 0.01, 2.0, None, False)]
    return spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, prompt string, complexity_tier_assigned int, "
                                       "routed_model string, cost double, latency double, quality_score double, "
                                       "was_escalated boolean")


def test_s1_s3_append_reject_and_scan(spark):
    path = scratch_path(spark, "t-log")
    L.append_request_telemetry(records(spark), path)
    L.append_request_telemetry(records(spark).where("id = 1"), path)
    log = L.scan_request_log(spark, path)
    assert sorted(r.id for r in log.collect()) == [1, 1, 2, 3]
    rows = {r.id: r for r in log.collect()}
    assert rows[1].prompt_hash == rows[2].prompt_hash          # stripped text hashes equal
    assert rows[2].was_escalated == 1 and rows[1].was_escalated == 0
    assert rows[3].timestamp is not None                       # default timestamp
    rej = spark.read.parquet(path + "_rejects").collect()
    assert [r.id for r in rej] == [4]
    pruned = log.where(F.col("day") == dt.date(2026, 6, 15))
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_s4_missing_table_reads_empty(spark):
    df = L.scan_routing_failures(spark, scratch_path(spark, "never-written"))
    assert df.count() == 0 and df.columns[:4] == ["id", "prompt", "assigned_tier", "true_tier"]


def test_w1_w2_latest_verdict_wins(spark):
    path = scratch_path(spark, "t-log-w")
    L.append_request_telemetry(records(spark), path)
    log = L.scan_request_log(spark, path).drop("day")
    assert [r.id for r in W.pending_batch(log, 5).collect()] == [1]
    verdicts = spark.createDataFrame([(1, 3.0, 1, 1), (1, 5.0, 0, 2), (2, 1.0, 1, 1)],
                                     "id long, quality_score double, was_escalated int, verdict_seq int")
    cur = {r.id: (r.quality_score, r.was_escalated) for r in W.current_log(log, verdicts).collect()}
    assert cur[1] == (5.0, 0) and cur[2] == (1.0, 1) and cur[3] == (4.5, 0)


def test_w5_stream_equals_batch(spark):
    path = scratch_path(spark, "t-log-s")
    L.append_request_telemetry(records(spark).where("id < 3"), path)
    out, ck = scratch_path(spark, "t-roll"), scratch_path(spark, "t-ck")
    W.live_daily_rollup(spark, path, out, ck)
    got = {r.day: (r.total_count, r.escalated_count) for r in W.read_live_rollup(spark, out).collect()}
    assert got == {dt.date(2026, 6, 14): (1, 0), dt.date(2026, 6, 15): (1, 1)}
    # a second availableNow run over the same checkpoint adds nothing (exactly-once)
    W.live_daily_rollup(spark, path, out, ck)
    assert W.read_live_rollup(spark, out).count() == 2
