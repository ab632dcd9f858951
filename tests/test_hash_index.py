"""Lookups by prompt hash read a bounded share of the index."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tierlens.session import scratch_path
from tierlens.sources import hash_index as HI
from tierlens.sources import logs as L
from tierlens.sources.shared_files import Sequence

from .test_hard_inputs import RECORD


def telemetry(spark, a, b):
    return spark.range(a, b).selectExpr(
        "id", "TIMESTAMP_NTZ'2025-01-01 10:00:00' + make_interval(0, 0, 0, id % 3) AS timestamp", "concat('p', id % 900) AS prompt", "1 AS complexity_tier_assigned",
        "'gpt-4o' AS routed_model", "0.1D AS cost", "1D AS latency", "CAST(NULL AS DOUBLE) AS quality_score", "false AS was_escalated").select("id", *[c.split()[0] for c in RECORD.split(", ")])


def h(i):
    return hashlib.sha256(f"p{i}".encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lookup_reads_few_partitions(spark):
    log = scratch_path(spark, "log")
    assert HI.update(spark, log) == 0 and HI.lookup(spark, log, [h(1)]).count() == 0
    L.append_request_telemetry(telemetry(spark, 0, 2000), log)
    assert HI.update(spark, log) == 1 and HI.update(spark, log) == 0
    L.append_request_telemetry(telemetry(spark, 2000, 3000), log)
    L.append_request_telemetry(telemetry(spark, 3000, 3500), log)
    assert HI.lookup(spark, log, [h(5)]).count() == 3                       # not indexed yet: whole updates only
    assert HI.update(spark, log) == 2
    wanted = [h(i) for i in range(0, 100)] + ["no such hash"]
    got = HI.lookup(spark, log, wanted)
    assert rows(got) == rows(HI.lookup_scan(spark, log, wanted)) and got.count() == 400
    assert rows(HI.lookup_table(spark, log, spark.createDataFrame([(x,) for x in wanted], "prompt_hash string"))) == rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and "PushedFilters: [In(prompt_hash" in plan.replace("IsNotNull(prompt_hash), ", "")
    files = HI.entries(spark, log).withColumn("f", F.input_file_name()).select("f").distinct().count()
    read = got.withColumn("f", F.input_file_name()).select("f").distinct().count()
    parts = HI.entries(spark, log).select("prefix").distinct().count()
    assert read <= 2 * len({x[:HI.DIGITS] for x in wanted}) < files and parts > 500
    with pytest.raises(ValueError, match="lookup_table"):
        HI.lookup(spark, log, [str(i) for i in range(HI.LITERALS + 1)])


def test_update_that_dies_or_loses_changes_nothing(spark, monkeypatch):
    log = scratch_path(spark, "log")
    L.append_request_telemetry(telemetry(spark, 0, 300), log)
    with monkeypatch.context() as m:
        m.setattr(Sequence, "offer", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            HI.update(spark, log)
    assert HI.entries(spark, log).count() == 0
    offer = Sequence.offer

    def late(self, n, r):
        monkeypatch.setattr(Sequence, "offer", offer)
        HI.update(spark, log)                                               # another update in between
        return offer(self, n, r)
    monkeypatch.setattr(Sequence, "offer", late)
    assert HI.update(spark, log) == 0 and HI.entries(spark, log).count() == 300
