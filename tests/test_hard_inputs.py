"""Inputs that the fixtures lack: malformed payloads, odd numbers, unresolved models,
rows without an id or a timestamp, late files and late outputs."""

import datetime as dt

from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.fixtures import verification_pairs
from tierlens.functions.json import is_json
from tierlens.operators import routing, telemetry, verify
from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.sources.responses import normalise_responses
from tierlens.streaming import jobs as W

from .conftest import SF_SMALL


def record(day, cost=0.5, flag=False, i=None, **more):
    r = {"timestamp": dt.datetime(2025, 1, day, 12), "prompt": f"p{day}", "complexity_tier_assigned": 1, "routed_model": "gpt-4o",
         "cost": cost, "latency": 1.0, "quality_score": None, "was_escalated": flag, **more}
    return r if i is None else {"id": i, **r}


RECORD = ("timestamp timestamp_ntz, prompt string, complexity_tier_assigned int, routed_model string, cost double, "
          "latency double, quality_score double, was_escalated boolean")


def frame(spark, rows):
    schema = ("id long, " if "id" in rows[0] else "") + RECORD
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def test_empty_lists_in_payloads_are_error_rows(spark):
    raw = spark.createDataFrame([("openai", "m", '{"choices": [], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}'),
                                 ("anthropic", "m", '{"content": [], "usage": {"input_tokens": 1, "output_tokens": 2}}'),
                                 ("openai", "n", '{"choices": [{"message": {"content": null}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}')],
                                "provider string, model_key string, raw_json string")
    got = [(r.model_key, r.output_text, r.error is None) for r in normalise_responses(raw).collect()]
    assert sorted(got, key=str) == [("m", None, False), ("m", None, False), ("n", "", True)]


def test_infinity_and_signed_nan(spark):
    texts = ['{"a":+Infinity}', '{"a":-Infinity}', '{"a":Infinity}', '{"a":NaN}', '{"a":INF}', '{"a":"+Infinity"}', '{"a":1e+5}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_json(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, True, True, True, False, True, True]
    judged = spark.createDataFrame([('{"score": "+nan"}',), ('{"score": "-nan"}',), ('{"score": "+inf"}',)], "v string")
    scores = [r.s for r in judged.select(verify.judge_parse(F.col("v"))["score"].alias("s")).collect()]
    assert scores[0] != scores[0] and scores[1] != scores[1] and scores[2] == float("inf")


def test_appends_without_id_get_distinct_ids(spark):
    path = scratch_path(spark, "log")
    for days in ([1, 2], [3, 4]):
        L.append_request_telemetry(frame(spark, [record(d) for d in days]), path)
    ids = [r.id for r in L.scan_request_log(spark, path).collect()]
    assert len(set(ids)) == 4
    log = L.scan_request_log(spark, path)
    verdicts = spark.createDataFrame([(ids[0], 5.0, 0, 1)], "id long, quality_score double, was_escalated int, verdict_seq int")
    assert W.current_log(log, verdicts).where("quality_score = 5.0").count() == 1
    fails = scratch_path(spark, "fails")
    for _ in range(2):
        L.append_routing_failures(spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "prompt string, assigned_tier int, true_tier int"), fails)
    assert L.scan_routing_failures(spark, fails).select("id").distinct().count() == 4


def test_odd_costs_and_missing_flags(spark):
    path = scratch_path(spark, "log")
    L.append_request_telemetry(frame(spark, [record(1, flag=None), record(2, cost=float("nan")), record(3, cost=2.5e10), record(4)]), path)
    log = L.scan_request_log(spark, path)
    assert sorted((r.cost, r.was_escalated) for r in log.collect()) == [(0.5, 0), (0.5, 0)]
    assert spark.read.parquet(path + "_rejects").count() == 2
    wild = spark.createDataFrame([(dt.datetime(2025, 1, 1), "gpt-4o", 2.5e10, 1, 0), (None, "gpt-4o", 1.0, 2, 0)],
                                 "timestamp timestamp_ntz, routed_model string, cost double, id long, was_escalated int")
    assert [str(r.day) for r in telemetry.spend_by(wild, "day").collect()] == ["2025-01-01"]
    assert telemetry.spend_by(wild, "week").count() == 1
    assert telemetry.escalation_rate(wild).count() == 1


def test_rollup_keeps_days_that_arrive_late(spark):
    log, out, ck = (scratch_path(spark, n) for n in ("log", "rollup", "ck"))
    for days in ([20, 21], [10, 11, 20]):
        L.append_request_telemetry(frame(spark, [record(d) for d in days]), log)
        W.live_daily_rollup(spark, log, out, ck, files_per_trigger=1)
    got = {r.day.day: r.total_count for r in W.read_live_rollup(spark, out).collect()}
    assert got == {20: 2, 21: 1, 10: 1, 11: 1}


def test_late_outputs_are_verified_and_an_empty_run_works(spark):
    log, out, ck = (scratch_path(spark, n) for n in ("log", "verdicts", "ck"))
    one = verification_pairs(spark, SF_SMALL).limit(1)
    frames = [one.withColumn("pair_id", F.explode(F.array(*[F.lit(i).cast("long") for i in ids]))) for ids in ([1], [1, 2])]
    W.continuous_verification(spark, _empty_log(spark, log), frames[0], out, ck)
    assert W.read_verdicts(spark, out).count() == 0
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    W.continuous_verification(spark, log, frames[0], out, ck)
    assert [r.id for r in W.read_verdicts(spark, out).collect()] == [1]
    W.continuous_verification(spark, log, frames[1], out, ck)
    assert sorted(r.id for r in W.read_verdicts(spark, out).collect()) == [1, 2]
    W.continuous_verification(spark, log, frames[1], out, ck)
    assert W.read_verdicts(spark, out).count() == 2


def _empty_log(spark, path):
    spark.createDataFrame([], L.LOG_TABLE_SCHEMA).drop("day").write.parquet(path)
    return path


def test_unresolved_models_stay_and_failed_calls_are_not_served(spark):
    req = spark.createDataFrame([(1, "gpt-4o", 10, 10), (2, "no-such-model", 10, 10)], "id int, model_key string, input_tokens long, output_tokens long")
    got = {r.id: r.cost for r in routing.with_cost(req, "model_key").collect()}
    assert set(got) == {1, 2} and got[2] is None
    assert {r.id for r in routing.lookup_model(req, "model_key").collect()} == {1, 2}
    assert [r.id for r in routing.unresolved_models(req, "model_key").collect()] == [2]
    calls = spark.createDataFrame([(1, True, "a", 1), (2, True, "b", 1), (3, False, "c", 1), (4, True, "d", 1)], "id int, failed boolean, out string, tier int")
    fb = spark.createDataFrame([(1, "A", C.FALLBACK_TIER), (4, None, C.FALLBACK_TIER)], "id int, out string, tier int")
    rows = {r.id: (r.out, r.tier, r.used_fallback) for r in routing.apply_fallback(calls, fb, "id", "failed", ["out", "tier"]).collect()}
    assert rows == {1: ("A", 3, True), 2: (None, None, False), 3: ("c", 1, False), 4: (None, 3, True)}


def test_attempt_chains(spark):
    from tierlens.plans.q_routing import POLICY
    cases = {
        1: [(1, 200, 1.0)], 2: [(1, 500, 1.0), (2, 201, 12.0)], 3: [(1, 404, 1.0), (2, 200, 1.0)],                 # served, served at the limit, refused
        4: [(1, 429, 1.0), (2, 503, 1.0), (3, None, None), (4, 502, 1.0)],                                         # exhausted
        5: [(1, 200, 12.5), (2, 404, 99.0), (3, 200, 3.0)],                                                        # late answers may be tried again
        6: [(1, 500, 1.0), (2, 500, 1.0)], 7: [(5, 200, 1.0), (None, 200, 1.0)], 8: [(2, 200, 1.0), (4, 500, 1.0)],  # open, nothing that counts, a gap
        9: [(1, 500, 1.0), (1, 200, 1.0), (1, 200, 1.0)], 10: [(1, 200, None)]}                                     # one attempt told three times
    rows = [(k, *a) for k, v in cases.items() for a in v]
    df = spark.createDataFrame(rows, "request_id int, attempt int, status int, latency_seconds double").repartition(4)
    got = {r.request_id: tuple(r)[1:] for r in routing.attempt_chains(df, POLICY).collect()}
    assert got == {1: ("served", 1, 200, 1, 0, False), 2: ("served", 2, 201, 2, 0, False), 3: ("refused", 1, 404, 1, 0, False),
                   4: ("exhausted", 4, 502, 4, 0, True), 5: ("served", 3, 200, 3, 2, False), 6: ("open", None, None, 2, 0, False),
                   7: ("open", None, None, 0, 0, False), 8: ("served", 2, 200, 1, 0, False), 9: ("served", 1, 200, 1, 0, False),
                   10: ("served", 1, 200, 1, 0, False)}
    plan = routing.attempt_chains(df, POLICY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert routing.attempt_chains(df.where("false"), POLICY).count() == 0
