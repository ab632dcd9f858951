"""Routing, pricing, provider-response, verification and escalation queries
(S8, R1-R8, V1-V9, E1-E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as fx_
from ..operators import escalate as E
from ..operators import routing as R
from ..operators import training as TR
from ..operators import verify as V
from ..sources.dims import load_policy
from ..sources.responses import normalise_responses
from ..tables import read
from . import oracle as O
from .registry import register

POLICY = load_policy()


def _q(s: str) -> str:
    return O._q(s)


def _logs_dims(body: str) -> str:
    return O.with_ctes(body, **O.fx("request_logs"), **O.dims_ctes(POLICY))


def _logs_routed(spark, sf_dir):
    return R.resolve_route(fx_.request_logs(spark, sf_dir), POLICY, "complexity_tier_assigned")


_ROUTE_TIER_SQL = f"CASE WHEN complexity_tier_assigned IN ({', '.join(map(str, POLICY.tiers))}) " \
                  f"THEN complexity_tier_assigned ELSE {C.FALLBACK_TIER} END"


# --------------------------------------------------------------------------- R1-R3, R8
@register("r1_resolve_route", _logs_dims(f"""
SELECT l.id, l.complexity_tier_assigned, p.route_tier, p.tier_name, p.policy_provider, p.policy_model_id,
  p.fallback_model_id, p.max_tokens, p.temperature
FROM request_logs l LEFT JOIN policy p ON p.route_tier = {_ROUTE_TIER_SQL}"""))
def q_r1(spark, sf_dir):
    return _logs_routed(spark, sf_dir).select(
        "id", "complexity_tier_assigned", "route_tier", "tier_name", "policy_provider", "policy_model_id",
        "fallback_model_id", "max_tokens", "temperature")


@register("r2_model_lookup", _logs_dims(f"""
SELECT l.id, p.route_tier, a.registry_key, r.provider, r.model_id, r.quality_tier
FROM request_logs l JOIN policy p ON p.route_tier = {_ROUTE_TIER_SQL}
JOIN aliases a ON a.model_ref = p.policy_model_id JOIN registry r ON r.key = a.registry_key"""))
def q_r2(spark, sf_dir):
    j = R.lookup_model(_logs_routed(spark, sf_dir), "policy_model_id", prefix="m_")
    return j.select("id", "route_tier", F.col("m_registry_key").alias("registry_key"),
                    F.col("m_provider").alias("provider"), F.col("m_model_id").alias("model_id"),
                    F.col("m_quality_tier").alias("quality_tier"))


@register("r3_policy_lint_by_traffic", _logs_dims(f"""
, ids AS (SELECT route_tier, 'primary' AS role, policy_model_id AS model_id FROM policy
          UNION ALL SELECT route_tier, 'fallback', fallback_model_id FROM policy),
bad AS (SELECT * FROM ids WHERE model_id NOT IN (SELECT key FROM registry))
SELECT b.route_tier, b.role, b.model_id, count(*) AS requests
FROM request_logs l JOIN bad b ON b.route_tier = {_ROUTE_TIER_SQL}
GROUP BY b.route_tier, b.role, b.model_id"""))
def q_r3(spark, sf_dir):
    """R3 weighted by traffic: how many logged requests route to a policy id that
    has no registry key (the strict lookup would fail for them)."""
    bad = R.policy_lint(POLICY, spark).withColumnRenamed("tier", "route_tier")
    routed = fx_.request_logs(spark, sf_dir).select(
        F.when(F.col("complexity_tier_assigned").isin(POLICY.tiers), F.col("complexity_tier_assigned"))
         .otherwise(F.lit(C.FALLBACK_TIER)).cast("int").alias("route_tier"))
    per_tier = routed.groupBy("route_tier").agg(F.count(F.lit(1)).alias("requests"))
    return per_tier.join(F.broadcast(bad), "route_tier").select("route_tier", "role", "model_id", "requests")


@register("r8_verification_queue", _logs_dims("""
SELECT l.id, l.complexity_tier_assigned, l.routed_model, r.key AS gold_model_key, r.model_id AS gold_model_id,
  r.provider AS gold_provider
FROM request_logs l JOIN registry r ON r.key = 'gpt-4o' WHERE l.complexity_tier_assigned < 3"""))
def q_r8(spark, sf_dir):
    logs = fx_.request_logs(spark, sf_dir).select("id", "complexity_tier_assigned", "routed_model")
    return R.verification_queue(logs, "complexity_tier_assigned")


# --------------------------------------------------------------------------- S8, R4, R7
_S8_SQL = f"""
SELECT request_id, lower(provider) AS provider, model_key,
  CASE WHEN lower(provider) = 'openai' THEN {O.sql_strip("coalesce(json_extract_string(raw_json, '$.choices[0].message.content'), '')")}
       WHEN lower(provider) = 'anthropic' THEN {O.sql_strip("json_extract_string(raw_json, '$.content[0].text')")}
       WHEN lower(provider) = 'ollama' THEN {O.sql_strip("json_extract_string(raw_json, '$.message.content')")} END AS output_text,
  CASE WHEN lower(provider) = 'openai' THEN CAST(json_extract(raw_json, '$.usage.prompt_tokens') AS BIGINT)
       WHEN lower(provider) = 'anthropic' THEN CAST(json_extract(raw_json, '$.usage.input_tokens') AS BIGINT)
       WHEN lower(provider) = 'ollama' THEN coalesce(CAST(json_extract(raw_json, '$.prompt_eval_count') AS BIGINT), 0) END AS input_tokens,
  CASE WHEN lower(provider) = 'openai' THEN CAST(json_extract(raw_json, '$.usage.completion_tokens') AS BIGINT)
       WHEN lower(provider) = 'anthropic' THEN CAST(json_extract(raw_json, '$.usage.output_tokens') AS BIGINT)
       WHEN lower(provider) = 'ollama' THEN coalesce(CAST(json_extract(raw_json, '$.eval_count') AS BIGINT), 0) END AS output_tokens,
  CASE WHEN lower(provider) NOT IN ('openai', 'anthropic', 'ollama') THEN
    {_q(C.PROVIDER_ERROR_BEFORE)} || lower(provider) || {_q(C.PROVIDER_ERROR_MIDDLE)} || model_key || {_q(C.PROVIDER_ERROR_AFTER)} || lower(provider)
  END AS error
FROM provider_responses"""


def _responses(spark, sf_dir):
    raw = read(spark, sf_dir, "lineitem", spread=True)
    return normalise_responses(fx_.provider_responses_from(raw), keep=["request_id"])


@register("s8_normalised_responses", O.with_ctes(
    "SELECT request_id, provider, model_key, CASE WHEN error IS NULL THEN output_text END AS output_text, "
    "CASE WHEN error IS NULL THEN input_tokens END AS input_tokens, "
    "CASE WHEN error IS NULL THEN output_tokens END AS output_tokens, error FROM s8",
    **O.fx("provider_responses"), s8=_S8_SQL))
def q_s8(spark, sf_dir):
    return _responses(spark, sf_dir)


_R4_SQL = O.with_ctes("""
SELECT s.request_id, s.model_key, r.model_id, s.input_tokens, s.output_tokens,
  s.input_tokens * r.cost_per_input_token + s.output_tokens * r.cost_per_output_token AS cost{extra}
FROM s8 s JOIN registry r ON r.key = s.model_key WHERE s.error IS NULL""",
                      **O.fx("provider_responses"), s8=_S8_SQL, registry=O.registry_values_sql())


def _priced_inputs(spark, sf_dir):
    """Rows of supported providers.  The filter is on the provider name (pushed to
    the scan, before any parsing); a malformed payload of a supported provider keeps
    its row with NULL tokens and therefore NULL cost."""
    from ..sources.responses import SUPPORTED
    r = _responses(spark, sf_dir).where(F.col("provider").isin(SUPPORTED))
    return r.drop("error", "provider", "output_text")


@register("r4_request_cost", _R4_SQL.replace("{extra}", ""))
def q_r4(spark, sf_dir):
    return R.with_cost(_priced_inputs(spark, sf_dir))


@register("r7_completion_facts", _R4_SQL.replace(
    "{extra}", ", s.input_tokens + s.output_tokens AS total_tokens, 1 AS complexity_tier_assigned, "
          "CAST(1.0 AS DOUBLE) AS confidence_score"))
def q_r7(spark, sf_dir):
    """R7 with the default route of D9 (no classifier artifact: tier 1, confidence 1.0)."""
    facts = R.completion_facts(R.with_cost(_priced_inputs(spark, sf_dir)))
    return facts.select("*", F.lit(C.DEFAULT_TIER).alias("complexity_tier_assigned"),
                        F.lit(C.DEFAULT_CONFIDENCE).alias("confidence_score"))


# --------------------------------------------------------------------------- R5, R6 (pairs)
def _pairs(spark, sf_dir):
    return fx_.verification_pairs(spark, sf_dir)


def _pairs_sql(body: str, **extra) -> str:
    return O.with_ctes(body, **O.fx("verification_pairs"), **extra)


def _r5(spark, sf_dir, *keep: str):
    """R5 over the pairs; ``keep`` names request columns to carry along."""
    pairs = _pairs(spark, sf_dir)
    req = pairs.select("pair_id", "predicted_tier", "primary_failed",
                       F.col("cheap_output").alias("output_text"), F.col("cheap_cost").alias("cost"))
    fb = pairs.where("primary_failed").select("pair_id", F.col("gold_output").alias("output_text"),
                                              F.col("gold_cost").alias("cost"))
    out = R.apply_fallback(req, fb, "pair_id", "primary_failed", ["output_text", "cost"])
    return out.select("pair_id", *keep, "output_text", "cost", "used_fallback",
                      F.when(F.col("used_fallback"), F.lit(C.FALLBACK_TIER)).otherwise(F.col("predicted_tier"))
                       .alias("final_tier"),
                      F.when(F.col("used_fallback"), F.lit(C.FALLBACK_CONFIDENCE)).otherwise(F.lit(C.DEFAULT_CONFIDENCE))
                       .alias("confidence"))


_R5_SQL = """
SELECT pair_id, CASE WHEN primary_failed THEN gold_output ELSE cheap_output END AS output_text,
  CASE WHEN primary_failed THEN gold_cost ELSE cheap_cost END AS cost, primary_failed AS used_fallback,
  CASE WHEN primary_failed THEN 3 ELSE predicted_tier END AS final_tier, CAST(1.0 AS DOUBLE) AS confidence
FROM verification_pairs"""


@register("r5_provider_fallback", _pairs_sql(_R5_SQL))
def q_r5(spark, sf_dir):
    return _r5(spark, sf_dir)


@register("r6_initial_log_values", _pairs_sql(f"""
SELECT r5.pair_id, r5.final_tier,
  CASE WHEN r5.used_fallback THEN rf.model_id ELSE rp.model_id END AS routed_model,
  CASE WHEN r5.final_tier = 3 THEN 4.5 END::DOUBLE AS initial_quality_score,
  CAST(r5.final_tier = 3 AND p.policy_model_id <> CASE WHEN r5.used_fallback THEN rf.model_id ELSE rp.model_id END
       AS INTEGER) AS initial_was_escalated
FROM r5 JOIN verification_pairs v USING (pair_id)
JOIN policy p ON p.route_tier = v.predicted_tier
JOIN aliases ap ON ap.model_ref = p.policy_model_id JOIN registry rp ON rp.key = ap.registry_key
JOIN aliases af ON af.model_ref = p.fallback_model_id JOIN registry rf ON rf.key = af.registry_key""",
    r5=_R5_SQL, **O.dims_ctes(POLICY)))
def q_r6(spark, sf_dir):
    """R5 -> R6: the serving model is the fallback's when the primary failed; the
    log gets quality 4.5 and an escalation flag for tier-3 rows served off-policy."""
    routed = R.resolve_route(_r5(spark, sf_dir, "predicted_tier"), POLICY, "predicted_tier")
    routed = R.lookup_model(routed, "policy_model_id", prefix="p_")
    routed = R.lookup_model(routed, "fallback_model_id", prefix="f_")
    routed = routed.select("pair_id", "final_tier", "policy_model_id",
                           F.when(F.col("used_fallback"), F.col("f_model_id")).otherwise(F.col("p_model_id"))
                            .alias("routed_model"))
    return R.initial_log_values(routed, "final_tier", "routed_model", "policy_model_id").drop("policy_model_id")


# --------------------------------------------------------------------------- R9
@register("r9_retry_eligibility", O.with_ctes(
    f"SELECT request_id, status, coalesce(status IN ({', '.join(map(str, POLICY.fallback_on_http_codes))}), false) AS retry_eligible "
    "FROM call_statuses", **O.fx("call_statuses")))
def q_r9(spark, sf_dir):
    """R9 over the HTTP status of each call; a call without a status is not retried."""
    return fx_.call_statuses(spark, sf_dir).select(
        "request_id", "status", F.coalesce(R.retry_eligible("status", POLICY), F.lit(False)).alias("retry_eligible"))


#: The runtime policy's values, written out: four attempts, 12 seconds, 429 / 500 / 502 / 503.
@register("r9_attempt_chains", O.with_ctes("""
, a AS (SELECT request_id, attempt, status, coalesce(latency_seconds > 12.0, FALSE) AS late,
    status IS NULL OR status IN (429, 500, 502, 503) AS listed FROM call_attempts WHERE attempt BETWEEN 1 AND 4),
k AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 AND NOT late THEN 'good' WHEN late OR listed THEN 'again' ELSE 'bad' END AS kind FROM a),
f AS (SELECT request_id, min(attempt) FILTER (kind <> 'again') AS stop, bool_or(attempt = 4) AS has_last FROM k GROUP BY request_id),
d AS (SELECT request_id, coalesce(stop, CASE WHEN has_last THEN 4 END) AS decided_at, stop FROM f)
SELECT d.request_id, CASE WHEN stop IS NOT NULL THEN CASE any_value(kind) FILTER (attempt = stop) WHEN 'good' THEN 'served' ELSE 'refused' END
    WHEN decided_at IS NOT NULL THEN 'exhausted' ELSE 'open' END AS outcome, decided_at,
  any_value(status) FILTER (attempt = decided_at) AS final_status, count(*) FILTER (decided_at IS NULL OR attempt <= decided_at) AS n_attempts,
  count(*) FILTER (late AND (decided_at IS NULL OR attempt <= decided_at)) AS n_late, stop IS NULL AND decided_at IS NOT NULL AS use_fallback
FROM d JOIN k USING (request_id) GROUP BY d.request_id, decided_at, stop
UNION ALL
SELECT DISTINCT request_id, 'open', NULL::INTEGER, NULL::INTEGER, 0, 0, FALSE FROM call_attempts
WHERE request_id NOT IN (SELECT request_id FROM a)""", **O.fx("call_attempts")))
def q_r9_chains(spark, sf_dir):
    """First success in each request's attempts under retry count, timeout and codes."""
    return R.attempt_chains(fx_.call_attempts(spark, sf_dir), POLICY)


@register("r2_unresolved_traffic", _logs_dims("""
SELECT routed_model AS model_ref, count(*) AS rows FROM request_logs
WHERE routed_model NOT IN (SELECT model_ref FROM aliases) GROUP BY routed_model"""))
def q_r2_unresolved(spark, sf_dir):
    """R2's error output over the log: served model names that the registry cannot resolve."""
    return R.unresolved_traffic(fx_.request_logs(spark, sf_dir), "routed_model")


# --------------------------------------------------------------------------- V1-V9
def _v_query(cols_sql: str) -> str:
    return _pairs_sql(f"SELECT pair_id, {cols_sql} FROM verification_pairs")


_e = O.sql_extraction("cheap_output", "gold_output")
_c = O.sql_classification("cheap_output", "gold_output")


@register("v1_extraction_check", _v_query(f"{_e[0]} AS passed, {_e[1]} AS score, {_e[2]} AS reason"))
def q_v1(spark, sf_dir):
    v = V.verify_extraction(F.col("cheap_output"), F.col("gold_output"))
    return _pairs(spark, sf_dir).select("pair_id", v.passed.alias("passed"), v.score.alias("score"),
                                        v.reason.alias("reason"))


@register("v2_missing_keys", _pairs_sql(
    f"SELECT pair_id, {O.sql_missing_keys('cheap_output', 'gold_output')} AS missing_keys, "
    f"len({O.sql_missing_keys('cheap_output', 'gold_output')}) AS n_missing FROM verification_pairs "
    f"WHERE task_type = 'extraction' AND json_valid({O.sql_json_block('cheap_output')}) "
    f"AND json_valid({O.sql_json_block('gold_output')})"))
def q_v2(spark, sf_dir):
    from ..functions.json import is_json, top_level_keys
    from ..functions.rows import keep_rows
    p = _pairs(spark, sf_dir).where(F.col("task_type") == "extraction")
    b = p.select("pair_id", V.json_block(F.col("cheap_output")).alias("_cb"),
                 V.json_block(F.col("gold_output")).alias("_gb"))
    b = keep_rows(b, is_json(F.col("_cb")) & is_json(F.col("_gb")))
    m = F.array_except(top_level_keys(F.col("_gb")), top_level_keys(F.col("_cb")))
    return b.select("pair_id", m.alias("missing_keys"), F.size(m).alias("n_missing"))


@register("v3_classification_check", _v_query(f"{_c[0]} AS passed, {_c[1]} AS score, {_c[2]} AS reason"))
def q_v3(spark, sf_dir):
    v = V.verify_classification(F.col("cheap_output"), F.col("gold_output"))
    return _pairs(spark, sf_dir).select("pair_id", v.passed.alias("passed"), v.score.alias("score"),
                                        v.reason.alias("reason"))


@register("v4_judge_prompt", _v_query(
    f"{_q(C.JUDGE_PROMPT_HEAD)} || original_prompt || {_q(C.JUDGE_PROMPT_MIDDLE)} || cheap_output || "
    f"{_q(C.JUDGE_PROMPT_TAIL)} AS judge_prompt"))
def q_v4(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "pair_id", V.judge_prompt(F.col("original_prompt"), F.col("cheap_output")).alias("judge_prompt"))


def _judge_q(mode):
    h, p, s, r = O.sql_judge("judge_output", mode)
    return _v_query(f"{h} AS has_result, {p} AS passed, {s} AS score, {r} AS reason")


@register("v5_judge_verdict_async", _judge_q("async"))
def q_v5(spark, sf_dir):
    v = V.judge_verdict_async(F.col("judge_output"))
    return _pairs(spark, sf_dir).select("pair_id", v.isNotNull().alias("has_result"), v.passed.alias("passed"),
                                        v.score.alias("score"), v.reason.alias("reason"))


_h5 = O.sql_judge("judge_output", "async")[0]


@register("v5_verdict_errors", _pairs_sql(
    f"SELECT pair_id, judge_output FROM verification_pairs WHERE task_type = 'summarization' AND NOT ({_h5})"))
def q_v5_errors(spark, sf_dir):
    """V5 error output: summarization verdicts that give no result."""
    return V.verdict_errors(_pairs(spark, sf_dir))


@register("v6_judge_verdict_sync", _judge_q("sync"))
def q_v6(spark, sf_dir):
    v = V.judge_verdict_sync(F.col("judge_output"))
    return _pairs(spark, sf_dir).select("pair_id", F.lit(True).alias("has_result"), v.passed.alias("passed"),
                                        v.score.alias("score"), v.reason.alias("reason"))


def _dispatch_sql(mode: str, extra_cols: str = "", where_extra: str = "") -> str:
    h, p, s, r = O.sql_dispatch("task_type", "cheap_output", "gold_output", "judge_output", mode)
    return (f"SELECT pair_id{extra_cols}, task_type, {p} AS passed, {s} AS score, {r} AS reason "
            f"FROM verification_pairs WHERE {h}{where_extra}")


@register("v7_dispatch_async", _pairs_sql(_dispatch_sql("async")))
def q_v7a(spark, sf_dir):
    return V.verify_pairs(_pairs(spark, sf_dir), "async")


@register("v7_dispatch_sync", _pairs_sql(_dispatch_sql("sync")))
def q_v7s(spark, sf_dir):
    return V.verify_pairs(_pairs(spark, sf_dir), "sync")


@register("v8_captured_savings", _pairs_sql(f"""
SELECT task_type, count(*) AS verified, count_if(passed) AS passed_count,
  CAST(coalesce(sum(CASE WHEN passed THEN CAST(gold_cost - cheap_cost AS DECIMAL(20,10)) END), 0) AS DOUBLE) AS captured_savings
FROM v GROUP BY task_type""", v=_dispatch_sql("async", ", gold_cost, cheap_cost")))
def q_v8(spark, sf_dir):
    """Rows without a verdict are not filtered out (that filter would be pushed into
    the scan and parse every judge text again); they are left out of the counts,
    and a task group left with no verdict at all is dropped after aggregation."""
    from ..functions.money import money_sum
    pairs = (_pairs(spark, sf_dir).where(F.col("task_type").isin(*V.VERIFIED_TASKS))
             .select("pair_id", "task_type", "cheap_output", "gold_output", "judge_output", "gold_cost", "cheap_cost"))
    r = F.col("_verdict")
    v = V.staged_verdicts(pairs, "async", drop_no_result=False)
    return (v.groupBy("task_type")
            .agg(F.count(r).alias("verified"), F.count_if(r["passed"]).alias("passed_count"),
                 money_sum(F.when(r["passed"], F.col("gold_cost") - F.col("cheap_cost"))).alias("captured_savings"))
            .where(F.col("verified") > 0))


@register("v9_failure_feed", _pairs_sql(
    f"SELECT pair_id AS id, predicted_tier AS assigned_tier, 3 AS true_tier, "
    f"{O.sql_routing_features('original_prompt', 'TRUE', '2', '1')} FROM v WHERE NOT passed",
    v=_dispatch_sql("sync", ", predicted_tier, original_prompt")))
def q_v9(spark, sf_dir):
    """Failed sync verdicts become routing failures (true tier = the gold tier 3),
    featurised with the D14 defaults."""
    v = V.verify_pairs(_pairs(spark, sf_dir), "sync", keep=["predicted_tier", "original_prompt"])
    feed = V.failure_feed(v, "pair_id", "original_prompt", F.col("predicted_tier"), F.lit(C.FALLBACK_TIER))
    return TR.featurise_failures(feed, keep=["id", "assigned_tier", "true_tier"])


# --------------------------------------------------------------------------- E1-E5
def _esc_sql(strict: bool) -> str:
    h, p, s, r = O.sql_dispatch("v.task_type", "v.cheap_output", "v.gold_output", "v.judge_output", "sync")
    esc = "false" if strict else f"NOT ({p})"
    gap = f"CASE WHEN v.task_type = 'summarization' THEN 4.0 - ({s}) ELSE 1.0 END"
    return _pairs_sql(f"""
, e AS (
  SELECT v.pair_id, v.cheap_output, v.gold_output, v.cheap_cost, v.gold_cost, {esc} AS escalated,
    rp.model_id AS original_model, rf.model_id AS escalated_model, v.gold_cost + v.cheap_cost AS cost_delta,
    CAST({gap} AS DOUBLE) AS quality_gap_score
  FROM verification_pairs v JOIN policy p ON p.route_tier = v.predicted_tier
  JOIN aliases ap ON ap.model_ref = p.policy_model_id JOIN registry rp ON rp.key = ap.registry_key
  JOIN aliases af ON af.model_ref = p.fallback_model_id JOIN registry rf ON rf.key = af.registry_key)
SELECT pair_id, escalated, CASE WHEN escalated THEN gold_output ELSE cheap_output END AS final_output,
  CASE WHEN escalated THEN gold_cost ELSE cheap_cost END AS final_cost,
  CASE WHEN escalated THEN original_model END AS original_model,
  CASE WHEN escalated THEN escalated_model END AS escalated_model,
  CASE WHEN escalated THEN cost_delta END AS cost_delta,
  CASE WHEN escalated THEN quality_gap_score END AS quality_gap_score
FROM e""", **O.dims_ctes(POLICY))


def _esc(spark, sf_dir, strict):
    pairs = _pairs(spark, sf_dir).select("pair_id", "predicted_tier", "task_type", "cheap_output", "gold_output",
                                         "judge_output", "cheap_cost", "gold_cost")
    out = E.flatten_log(E.escalate(pairs, POLICY, strict_sla=strict))
    return out.select("pair_id", "escalated", "final_output", "final_cost", "original_model", "escalated_model",
                      "cost_delta", "quality_gap_score")


@register("e1_strict_sla", _esc_sql(True))
def q_e1(spark, sf_dir):
    return _esc(spark, sf_dir, True)


@register("e2_e5_flexible_sla", _esc_sql(False))
def q_e2(spark, sf_dir):
    return _esc(spark, sf_dir, False)
