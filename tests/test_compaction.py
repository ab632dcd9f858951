"""W2 as base and deltas: equal to the plain join at any time, whole under crashes."""

import random

import pytest
from pyspark.sql import functions as F

from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.sources.shared_files import Sequence
from tierlens.streaming import compaction as CO
from tierlens.streaming import jobs as W

from .test_hard_inputs import frame, record


def land_verdicts(spark, path, batch, rows):
    df = spark.createDataFrame([(i, s, e, None if d is None else f"2025-01-{d:02d}") for i, s, e, d in rows], "id long, quality_score double, was_escalated int, day string")
    W._batch_writer(path)(df.withColumn("day", F.col("day").cast("date")), batch)


def plain(spark, log, verdicts):
    return W.current_log(L.scan_request_log(spark, log), W.read_verdicts(spark, verdicts).drop("day"))


def same(spark, log, verdicts):
    key = lambda df: sorted(map(tuple, df.select(*L.LOG_COLUMNS, "day").collect()), key=repr)
    a, b = key(CO.read_current(spark, log, verdicts)), key(plain(spark, log, verdicts))
    assert a == b
    return len(a)


def test_current_log_at_any_time(spark):
    random.seed(4)
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    assert not CO.compact(spark, log, verdicts) and CO.read_current(spark, log, verdicts).count() == 0
    days, n = {}, 0
    for batch in range(5):
        new = [record(random.randrange(1, 6), i=n + k) for k in range(4)]
        days |= {r["id"]: r["timestamp"].day for r in new}
        n += 4
        L.append_request_telemetry(frame(spark, new), log)
        land_verdicts(spark, verdicts, batch, [(i, float(batch), i % 2, days[i] if random.random() < 0.8 else None) for i in random.sample(range(n), 3)])
        assert same(spark, log, verdicts) == n
        if batch % 2 == 0:
            assert CO.compact(spark, log, verdicts)
            assert same(spark, log, verdicts) == n and not CO.compact(spark, log, verdicts)
    CO.compact(spark, log, verdicts)
    files = CO.read_current(spark, log, verdicts).inputFiles()
    assert files and all("_current/base/" in f for f in files)             # no append, no verdict is read
    plan = CO.read_current(spark, log, verdicts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    pruned = CO.read_current(spark, log, verdicts).where("day = DATE'2025-01-02'")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_only_touched_days_are_written(spark):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2), record(3, i=3)]), log)
    CO.compact(spark, log, verdicts)
    first = Sequence(spark, log + "_current", "manifest").read(0)["days"]
    land_verdicts(spark, verdicts, 0, [(2, 5.0, 0, 2)])
    CO.compact(spark, log, verdicts)
    second = Sequence(spark, log + "_current", "manifest").read(1)["days"]
    assert {d for d in first if first[d] != second[d]} == {"2025-01-02"} and same(spark, log, verdicts) == 3
    assert [(r.version, r.day) for r in CO.vacuum_candidates(spark, log).collect()] == [(first["2025-01-02"], "2025-01-02")]


def test_death_between_write_and_switch(spark, monkeypatch):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    CO.compact(spark, log, verdicts)
    land_verdicts(spark, verdicts, 0, [(1, 2.0, 1, 1)])
    with monkeypatch.context() as m:
        m.setattr(Sequence, "offer", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            CO.compact(spark, log, verdicts)
    assert same(spark, log, verdicts) == 2                                  # the old base and the delta
    assert CO.compact(spark, log, verdicts) and same(spark, log, verdicts) == 2
    assert {r.id: r.quality_score for r in CO.read_current(spark, log, verdicts).collect()}[1] == 2.0


def test_of_two_compactions_one_gives_way(spark, monkeypatch):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    offer = Sequence.offer

    def late(self, n, r):
        monkeypatch.setattr(Sequence, "offer", offer)
        assert CO.compact(spark, log, verdicts)                             # the other one, in between
        return offer(self, n, r)
    monkeypatch.setattr(Sequence, "offer", late)
    assert not CO.compact(spark, log, verdicts)
    assert same(spark, log, verdicts) == 2


def test_unfinished_appends_are_left_alone(spark):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    L.append_request_telemetry(frame(spark, [record(1, i=1)]), log)
    spark.createDataFrame([(1,)], "x int").write.parquet(log + "/append=7/_temporary/0")   # another writer's work
    CO.compact(spark, log, verdicts)
    assert Sequence(spark, log + "_current", "manifest").read(0)["appends"] == [[0, 0]]


def test_ranges():
    for s in [set(), {3}, {-5, 0, 1, 2, 9}, set(range(50)) - {7}]:
        assert CO._numbers(CO._ranges(s)) == s and all(CO._in(x, CO._ranges(s)) == (x in s) for x in range(-6, 55))
