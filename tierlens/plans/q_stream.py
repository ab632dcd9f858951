"""Request-log sinks/scans and worker/streaming queries.

Streaming queries run with ``trigger(availableNow=True)`` over landing folders
written from the fixtures, then read their sink back: the result must equal the
batch computation (the oracle is the batch SQL).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx_
from ..session import scratch_path
from ..sources import hash_index as HI
from ..sources import logs as L
from ..streaming import compaction as CO
from ..streaming import jobs as W
from . import oracle as O
from .q_routing import _dispatch_sql
from .registry import register

LOG_COLS = ", ".join(L.LOG_COLUMNS)


def _write_log(spark, sf_dir) -> str:
    """S1 over the raw telemetry records; returns the table path."""
    path = scratch_path(spark, "request-log")
    L.append_request_telemetry(fx_.telemetry_records(spark, sf_dir), path)
    return path


def _landing(df, spark, name) -> str:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path


def _logs_sql(body: str, **extra) -> str:
    return O.with_ctes(body, **O.fx("request_logs"), **extra)


# --------------------------------------------------------------------------- S1-S3
@register("s1_s3_request_log_roundtrip", _logs_sql(
    f"SELECT {LOG_COLS}, CAST(timestamp AS DATE) AS day FROM request_logs"))
def q_s1_s3(spark, sf_dir):
    """S1 append (hash, flag, validity, day partitions) then S3 scan of the table."""
    return L.scan_request_log(spark, _write_log(spark, sf_dir))


@register("s1_day_partitions", _logs_sql(
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS rows FROM request_logs GROUP BY 1"))
def q_s1_days(spark, sf_dir):
    """Rows per ``day`` partition of the written log (partition values come from the
    directory names, so this reads only file metadata and one column)."""
    return L.scan_request_log(spark, _write_log(spark, sf_dir)).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


@register("s1_leased_identity", _logs_sql(
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS rows, count(*) AS ids FROM request_logs GROUP BY 1"))
def q_s1_leases(spark, sf_dir):
    """Two appends without ids: rows and distinct ids per day (of the whole log, ids are told
    apart before days are)."""
    path = scratch_path(spark, "leased-log")
    records = fx_.telemetry_records(spark, sf_dir)
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        L.append_request_telemetry(records.where(part).drop("id"), path)
    once = L.scan_request_log(spark, path).groupBy("id").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("n"))
    return once.groupBy("day").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"))


@register("p3_hash_index_lookup", _logs_sql("""
, top AS (SELECT prompt_hash FROM request_logs GROUP BY prompt_hash ORDER BY count(*) DESC, prompt_hash LIMIT 100)
SELECT prompt_hash, id, CAST(timestamp AS DATE) AS day, routed_model, timestamp FROM request_logs JOIN top USING (prompt_hash)"""))
def q_p3_index(spark, sf_dir):
    """The requests of the 100 most repeated prompts (the report's length) through the hash
    index, which was built from two appends."""
    records, log = fx_.telemetry_records(spark, sf_dir), scratch_path(spark, "indexed-log")
    for part in (0, 1):
        L.append_request_telemetry(records.where(records.id % 2 == part), log)
        HI.update(spark, log)
    top = HI.entries(spark, log).groupBy("prompt_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "prompt_hash").limit(100)
    return HI.lookup(spark, log, [r.prompt_hash for r in top.collect()])


_FEATS_SQL = O.sql_routing_features("prompt", "TRUE", "2", "1")


@register("s2_s4_failures_roundtrip", O.with_ctes(
    f"SELECT id, assigned_tier, true_tier, {_FEATS_SQL}, sha256(prompt) AS prompt_sha256 FROM routing_failure_events",
    **O.fx("routing_failure_events")))
def q_s2_s4(spark, sf_dir):
    """S2 append of featurised failures, then S4 scan."""
    path = scratch_path(spark, "routing-failures")
    L.append_routing_failures(fx_.routing_failure_events(spark, sf_dir), path)
    f = L.scan_routing_failures(spark, path)
    return f.select("id", "assigned_tier", "true_tier", *L.FAILURE_SCHEMA.fieldNames()[4:9],
                    F.sha2("prompt", 256).alias("prompt_sha256"))


# --------------------------------------------------------------------------- W1 / W2
@register("w1_pending_batch", _logs_sql(
    f"SELECT {LOG_COLS} FROM request_logs WHERE quality_score IS NULL AND complexity_tier_assigned < 3 "
    f"ORDER BY id LIMIT 5"))
def q_w1(spark, sf_dir):
    return W.pending_batch(fx_.request_logs(spark, sf_dir))


_VERDICTS_SQL = _dispatch_sql("sync").replace("SELECT pair_id", "SELECT pair_id AS id", 1).replace(
    "FROM verification_pairs", "FROM verification_pairs JOIN pend ON pend.id = verification_pairs.pair_id", 1)
_VERDICT_CTES = dict(**O.fx("verification_pairs"),
                     pend="SELECT id FROM request_logs WHERE quality_score IS NULL AND complexity_tier_assigned < 3",
                     vd=_VERDICTS_SQL,
                     verdicts="SELECT id, score AS quality_score, CAST(NOT passed AS INTEGER) AS was_escalated FROM vd")


@register("w2_current_log", _logs_sql(
    "SELECT l.id, l.timestamp, l.prompt_hash, l.complexity_tier_assigned, l.routed_model, l.cost, l.latency, "
    "coalesce(v.quality_score, l.quality_score) AS quality_score, coalesce(v.was_escalated, l.was_escalated) "
    "AS was_escalated FROM request_logs l LEFT JOIN verdicts v USING (id)", **_VERDICT_CTES))
def q_w2(spark, sf_dir):
    logs = fx_.request_logs(spark, sf_dir)
    verdicts = W.verdicts_for(W.pending_filter(logs), fx_.verification_pairs(spark, sf_dir))
    return W.current_log(logs, verdicts.withColumn("verdict_seq", F.lit(1)))


# --------------------------------------------------------------------------- W3-W6
@register("w3_continuous_verification", _logs_sql("SELECT * FROM verdicts", **_VERDICT_CTES))
def q_w3(spark, sf_dir):
    """The log streams in; the outputs of even requests are there, those of odd ones come later."""
    log, pairs = _write_log(spark, sf_dir), fx_.verification_pairs(spark, sf_dir)
    landing, out, ck = (scratch_path(spark, n) for n in ("landing-pairs", "verdicts", "ck-w3"))
    for part in (F.col("pair_id") % 2 == 0, F.col("pair_id") % 2 == 1):
        pairs.where(part).write.mode("append").parquet(landing)
        W.stateful_verification(spark, log, landing, pairs.schema, out, ck)
    return W.read_verdicts(spark, out).select("id", "quality_score", "was_escalated")


@register("w2_compacted_log", _logs_sql(
    "SELECT l.id, l.timestamp, l.prompt_hash, l.complexity_tier_assigned, l.routed_model, l.cost, l.latency, "
    "coalesce(v.quality_score, l.quality_score) AS quality_score, coalesce(v.was_escalated, l.was_escalated) "
    "AS was_escalated, CAST(l.timestamp AS DATE) AS day FROM request_logs l LEFT JOIN verdicts v USING (id)", **_VERDICT_CTES))
def q_w2_compacted(spark, sf_dir):
    """Two rounds of append, verification and compaction, then an append and verdicts that the
    base does not hold yet."""
    records, pairs = fx_.telemetry_records(spark, sf_dir), fx_.verification_pairs(spark, sf_dir)
    log, landing, out, ck = (scratch_path(spark, n) for n in ("request-log", "landing-pairs", "verdicts", "ck-w2"))
    pairs.write.parquet(landing)
    for part in range(3):
        L.append_request_telemetry(records.where(F.col("id") % 3 == part), log)
        W.stateful_verification(spark, log, landing, pairs.schema, out, ck)
        if part < 2:
            CO.compact(spark, log, out)
    return CO.read_current(spark, log, out)


@register("w4_stream_request_telemetry", _logs_sql(
    f"SELECT {LOG_COLS}, CAST(timestamp AS DATE) AS day FROM request_logs"))
def q_w4(spark, sf_dir):
    records = fx_.telemetry_records(spark, sf_dir)
    landing = _landing(records, spark, "landing-telemetry")
    log, ck = scratch_path(spark, "stream-log"), scratch_path(spark, "ck-w4")
    W.stream_request_telemetry(spark, landing, records.schema, log, ck)
    return L.scan_request_log(spark, log)


_M = "DECIMAL(20,10)"
_BASE = ("CASE WHEN contains(lower(routed_model), 'gpt-4o-mini') THEN cost * 25.0 "
         "WHEN contains(lower(routed_model), 'haiku') OR contains(lower(routed_model), 'llama') "
         "THEN cost * 30.0 ELSE cost END")


@register("w5_live_daily_rollup", _logs_sql(f"""
SELECT CAST(timestamp AS DATE) AS day, CAST(sum(CAST(cost AS {_M})) AS DOUBLE) AS cost,
  CAST(sum(CAST({_BASE} AS {_M})) AS DOUBLE) AS gpt4o_baseline_cost, count(id) AS total_count,
  CAST(sum(was_escalated) AS BIGINT) AS escalated_count,
  CAST(sum(was_escalated) AS DOUBLE) / CAST(count(id) AS DOUBLE) * 100.0 AS escalation_rate_pct
FROM request_logs WHERE timestamp IS NOT NULL GROUP BY 1"""))
def q_w5(spark, sf_dir):
    """The later half of each month arrives first, then the earlier half: two runs."""
    records = fx_.telemetry_records(spark, sf_dir)
    late = F.coalesce(F.dayofmonth("timestamp") > 15, F.lit(False))
    log, out, ck = (scratch_path(spark, n) for n in ("request-log", "rollup", "ck-w5"))
    for part in (late, ~late):
        L.append_request_telemetry(records.where(part), log)
        W.live_daily_rollup(spark, log, out, ck)
    return W.read_live_rollup(spark, out)


@register("w6_stream_failure_capture", O.with_ctes(
    f"SELECT id, assigned_tier, true_tier, {_FEATS_SQL} FROM routing_failure_events",
    **O.fx("routing_failure_events")))
def q_w6(spark, sf_dir):
    events = fx_.routing_failure_events(spark, sf_dir)
    landing = _landing(events, spark, "landing-failures")
    out, ck = scratch_path(spark, "stream-failures"), scratch_path(spark, "ck-w6")
    W.stream_failure_capture(spark, landing, events.schema, out, ck)
    f = L.scan_routing_failures(spark, out)
    return f.select("id", "assigned_tier", "true_tier", *L.FAILURE_SCHEMA.fieldNames()[4:9])
