"""What concurrent or dying writers may do: the id ledger (S1, S2) and the model store."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel

from tierlens import constants as C
from tierlens.operators import training as TR
from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.sources import model_store as MS
from tierlens.sources import shared_files as SF
from tierlens.sources.ledger import LAST_ID, RESERVE, Ledger

from .test_training_props import small_matrix


def telemetry(spark, n, ids=None, cost=0.001):
    rows = [(dt.datetime(2026, 6, 1 + i % 3), f"p{i}", 1, "gpt-4o-mini", cost, 0.1, None, False) for i in range(n)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, prompt string, complexity_tier_assigned int, routed_model string, cost double, "
                                     "latency double, quality_score double, was_escalated boolean")
    if ids is None:
        return df.repartition(3)
    more = spark.createDataFrame(list(zip([f"p{i}" for i in range(n)], ids)), "prompt string, id long")
    return df.join(more, "prompt")


def test_publish_is_exclusive_and_whole(spark):
    path = scratch_path(spark, "t-publish")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: SF.publish(spark, f"{path}/x", f"writer {i}"), range(16)))
    assert sum(won) == 1 and SF.read_text(spark, f"{path}/x") == f"writer {won.index(True)}"
    assert [n for n in SF.names(spark, path) if not n.endswith(".crc")] == ["x"] and SF.names(spark, path + "-absent") == []


def test_leases_never_overlap(spark):
    path = scratch_path(spark, "t-lease")
    ledger = Ledger(spark, path)
    with ThreadPoolExecutor(6) as pool:
        leases = list(pool.map(lambda _: Ledger(spark, path).lease(), range(12)))
    starts = sorted(x.start for x in leases)
    assert starts == [i * RESERVE for i in range(12)]                      # open ones (or dead ones) keep their whole range
    last = max(leases, key=lambda x: x.start)
    ledger.close(last, last.start + 10)
    assert ledger.lease().start == last.start + 10                         # the unused rest came back
    ledger.close(leases[0], leases[0].start)                               # an older one: changes nothing later
    with pytest.raises(ValueError):
        ledger.close(last, last.start - 1)
    high = ledger.lease(1 << 60)
    ledger.close(high, high.start)                                         # as an append that brings ids does
    assert high.start == 1 << 60 and ledger.lease(5).start == 1 << 60
    with pytest.raises(RuntimeError, match="no ids"):
        ledger.lease(LAST_ID - 5)


def test_parallel_appends_have_different_ids(spark):
    path = scratch_path(spark, "t-par")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: L.append_request_telemetry(telemetry(spark, n), path), [40, 30, 20, 10]))
    log = L.scan_request_log(spark, path)
    assert log.count() == 100 == log.select("id").distinct().count()


def test_append_reads_no_log_and_survives_a_dead_writer(spark, monkeypatch):
    path = scratch_path(spark, "t-dead")
    L.append_request_telemetry(telemetry(spark, 5), path)
    before = {r.id for r in L.scan_request_log(spark, path).collect()}
    with pytest.raises(RuntimeError, match="died"):
        with L.identified(telemetry(spark, 1), path) as (rows, _, _):
            lost = rows.first().id
            raise RuntimeError("died")
    day = os.path.join(path, "append=0", "day=2026-06-01")
    real = [f for f in os.listdir(day) if f.startswith("part-")][0]
    with open(os.path.join(day, "part-broken.parquet"), "wb") as f:        # whoever reads the log fails now
        f.write(b"not parquet")
    L.append_request_telemetry(telemetry(spark, 5), path)
    os.replace(os.path.join(day, real), os.path.join(day, "part-broken.parquet"))
    after = {r.id for r in spark.read.schema(L.LOG_TABLE_SCHEMA).parquet(path).collect()} - before
    assert len(after) == 5 and lost not in after and min(after) >= RESERVE


def test_brought_ids_raise_the_ledger_and_null_ids_are_rejected(spark):
    path = scratch_path(spark, "t-ids")
    L.append_request_telemetry(telemetry(spark, 4, [7, None, 900, 3]), path)
    L.append_request_telemetry(telemetry(spark, 3), path)
    ids = sorted(r.id for r in L.scan_request_log(spark, path).collect())
    assert ids[:3] == [3, 7, 900] and min(ids[3:]) > 900 and len(ids) == 6
    assert [r.id for r in spark.read.parquet(path + "_rejects").collect()] == [None]
    fails = scratch_path(spark, "t-fails")
    events = spark.createDataFrame([(1, "a", 1, 2), (None, "b", 1, 3)], "id long, prompt string, assigned_tier int, true_tier int")
    L.append_routing_failures(events, fails)
    L.append_routing_failures(events.drop("id"), fails)
    got = L.scan_routing_failures(spark, fails).collect()
    assert len(got) == 3 == len({r.id for r in got}) and spark.read.parquet(fails + "_rejects").count() == 1


def test_rejects_only_where_there_are_some(spark):
    path = scratch_path(spark, "t-rej")
    L.append_request_telemetry(telemetry(spark, 3), path)
    assert not SF.exists(spark, path + "_rejects")
    L.append_request_telemetry(telemetry(spark, 2, cost=float("nan")), path)
    assert L.scan_request_log(spark, path).count() == 3 and spark.read.parquet(path + "_rejects").count() == 2


# --------------------------------------------------------------------------- S7
@pytest.fixture(scope="module")
def models(spark):
    m = small_matrix(spark)
    return m, TR.train_forest(m, "tier_label"), TR.train_forest(m.where("token_count > 40"), "tier_label")


def same(m, a, b):
    s = lambda x: [tuple(r) for r in TR.score(m, x, ["tier_label"]).orderBy(*m.columns[-1:], "confidence", "predicted_tier").collect()]
    return s(a) == s(b)


def test_reader_during_a_save_sees_the_old_model(spark, models, monkeypatch):
    m, first, second = models
    path = scratch_path(spark, "t-store")
    MS.save_model(first, path, "1.0.0")
    folder = MS.write_version(path, "1.1.0", second)                       # written, not promoted: nobody sees it
    model, meta = MS.load_model(spark, path)
    assert meta.first().version_tag == "1.0.0" and same(m, model, first)
    monkeypatch.setattr(MS, "node_table", lambda model: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        MS.save_model(second, path, "1.2.0")                               # dies half-way
    assert MS.load_model(spark, path)[1].first().version_tag == "1.0.0"
    assert MS.promote(spark, path, folder, 0.9)
    model, meta = MS.load_model(spark, path)
    assert meta.first().version_tag == "1.1.0" and same(m, model, second) and meta.first().input_features == C.FEATURE_COLUMNS


def test_gate_rollback_and_history(spark, models):
    _, first, second = models
    path = scratch_path(spark, "t-gate")
    a, b = MS.write_version(path, "1.0.0", first), MS.write_version(path, "1.1.0", second)
    assert not MS.promote(spark, path, a, 0.79) and not MS.promote(spark, path, a, None) and not MS.promote(spark, path, a, float("nan"))
    assert MS.load_model(spark, path) == (None, None) and not MS.rollback(spark, path)
    assert MS.promote(spark, path, a, 0.80) and MS.promote(spark, path, b, 0.95)
    assert MS.rollback(spark, path) and MS.load_nodes(spark, path)[1].first().version_tag == "1.0.0"
    assert not MS.rollback(spark, path)                                    # nothing before the first
    assert [(r.version_tag, r.accuracy, r.action) for r in MS.history(spark, path).orderBy("seq").collect()] == [
        ("1.0.0", 0.80, "promote"), ("1.1.0", 0.95, "promote"), ("1.0.0", 0.80, "rollback")]


def test_only_absence_means_no_model(spark, models):
    path = scratch_path(spark, "t-absent")
    assert MS.load_model(spark, path) == (None, None) and MS.load_nodes(spark, path) == (None, None)
    MS._point(spark, path, {"folder": "gone", "version_tag": "x", "accuracy": None, "action": "promote"})
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system says
        MS.load_model(spark, path)


def test_parallel_promotions_keep_every_pointer(spark, models):
    path = scratch_path(spark, "t-many")
    folder = MS.write_version(path, "1.0.0", nodes=spark.createDataFrame([], "tree int"))
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda i: MS.promote(spark, path, folder, 0.8 + i / 100), range(8)))
    assert sorted(r.accuracy for r in MS.history(spark, path).collect()) == [0.8 + i / 100 for i in range(8)]


def test_loaded_pipeline_is_the_saved_one(spark, models):
    m, first, _ = models
    path = scratch_path(spark, "t-same")
    MS.save_model(first, path, "1.0.0")
    model, _ = MS.load_model(spark, path)
    assert isinstance(model, PipelineModel) and same(m, model, first)


# --------------------------------------------------------------------------- W4 / W6
def test_streamed_records_get_ids_once(spark, monkeypatch):
    from tierlens.streaming import jobs as W
    landing, log, ck = (scratch_path(spark, n) for n in ("landing", "log", "ck"))
    first = telemetry(spark, 6)
    first.write.parquet(landing)
    close, died = Ledger.close, []

    def dying(self, lease, end):
        if not died:
            died.append(lease)
            raise RuntimeError("died after the write, before the commit")
        close(self, lease, end)
    monkeypatch.setattr(Ledger, "close", dying)
    with pytest.raises(Exception, match="died"):
        W.stream_request_telemetry(spark, landing, first.schema, log, ck)
    assert L.scan_request_log(spark, log).count() == 6
    W.stream_request_telemetry(spark, landing, first.schema, log, ck)      # the same batch again: replaced, not doubled
    telemetry(spark, 4, cost=float("nan")).unionByName(telemetry(spark, 3)).write.mode("append").parquet(landing)
    W.stream_request_telemetry(spark, landing, first.schema, log, ck)
    L.append_request_telemetry(telemetry(spark, 2), log)
    ids = [r.id for r in L.scan_request_log(spark, log).collect()]
    assert len(ids) == 11 == len(set(ids)) and spark.read.parquet(log + "_rejects").count() == 4


def test_streamed_failures(spark):
    from tierlens.streaming import jobs as W
    landing, out, ck = (scratch_path(spark, n) for n in ("landing", "fails", "ck"))
    events = spark.createDataFrame([(1, "a", 1, 2), (None, "b", 1, 3), (5, "c", 1, 3)], "id long, prompt string, assigned_tier int, true_tier int")
    events.write.parquet(landing)
    for _ in range(2):
        W.stream_failure_capture(spark, landing, events.schema, out, ck)
    assert sorted(r.id for r in L.scan_routing_failures(spark, out).collect()) == [1, 5]
    assert [r.prompt for r in spark.read.parquet(out + "_rejects").collect()] == ["b"]
    L.append_routing_failures(events.drop("id"), out)
    assert min(r.id for r in L.scan_routing_failures(spark, out).collect() if r.id not in (1, 5)) > 5
