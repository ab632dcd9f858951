"""Escalation accounting (E1-E5) over requests joined with their cheap, gold and
judge outputs.  A narrow projection after two broadcast dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.dims import Policy
from .routing import lookup_model, resolve_route
from .verify import staged_verdicts


def escalate(requests: DataFrame, policy: Policy, strict_sla: bool | Column = True, tier: str = "predicted_tier",
             task: str = "task_type", cheap: str = "cheap_output", gold: str = "gold_output",
             judge: str = "judge_output", cheap_cost: str = "cheap_cost", gold_cost: str = "gold_cost") -> DataFrame:
    """Strict SLA -> the cheap response, not escalated, no log.  Flexible SLA ->
    verify (V7 sync); E2: a failed check escalates to the policy fallback, whose
    response is ``gold`` at ``gold_cost``; E3: cost_delta = both costs added;
    E4: quality gap 4.0 - score for summaries, else 1.0; E5: log struct or NULL."""
    strict = F.lit(strict_sla) if isinstance(strict_sla, bool) else strict_sla
    routed = resolve_route(requests, policy, tier)
    routed = lookup_model(routed, "policy_model_id", prefix="cheap_")
    routed = lookup_model(routed, "fallback_model_id", prefix="fb_")
    v = staged_verdicts(routed, "sync", task, cheap, gold, judge)
    v = v.select("*", F.when(~strict, F.col("_verdict")).alias("_v"))
    escalated = F.coalesce(~strict & ~F.col("_v.passed"), F.lit(False))
    gap = F.when(F.col(task) == "summarization", F.lit(C.MIN_SUMMARY_SCORE) - F.col("_v.score")).otherwise(
        F.lit(C.NON_SUMMARY_QUALITY_GAP))
    log = F.struct(F.col("cheap_model_id").alias("original_model"), F.col("fb_model_id").alias("escalated_model"),
                   (F.col(gold_cost) + F.col(cheap_cost)).alias("cost_delta"), gap.alias("quality_gap_score"))
    return v.select(*requests.columns, escalated.alias("escalated"),
                    F.when(escalated, F.col(gold)).otherwise(F.col(cheap)).alias("final_output"),
                    F.when(escalated, F.col(gold_cost)).otherwise(F.col(cheap_cost)).alias("final_cost"),
                    F.when(escalated, log).alias("escalation_log"))


def flatten_log(df: DataFrame) -> DataFrame:
    """E5 log fields as columns (NULL when not escalated)."""
    return df.select(*[c for c in df.columns if c != "escalation_log"],
                     "escalation_log.original_model", "escalation_log.escalated_model",
                     "escalation_log.cost_delta", "escalation_log.quality_gap_score")
