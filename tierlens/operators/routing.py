"""Routing and cost (R1-R9): policy resolution, model lookup, pricing, fallback,
initial log values, completion facts, verification queueing, retry eligibility.

The two dimensions are configuration-sized (3 tiers, 5 models + aliases), so every
lookup is a broadcast hash join: the big side is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.dims import Policy, model_aliases, model_registry, policy_frame, registry_entry


def resolve_route(df: DataFrame, policy: Policy, tier: str = "tier") -> DataFrame:
    """Attach the policy row of the tier; a tier missing from the policy takes
    the tier-3 row.  Adds ``route_tier`` and the policy columns."""
    spark = df.sparkSession
    route_tier = F.when(F.col(tier).isin(policy.tiers), F.col(tier)).otherwise(F.lit(C.FALLBACK_TIER))
    pol = policy_frame(spark, policy).withColumnRenamed("tier", "route_tier")
    return df.withColumn("route_tier", route_tier.cast("int")).join(F.broadcast(pol), "route_tier", "left")


def lookup_model(df: DataFrame, model_ref: str, prefix: str = "", strict: bool = True) -> DataFrame:
    """R2: registry row for a model reference (registry key or aliased policy id).

    No row is lost: where the reference resolves to no registry key the registry columns
    are NULL, and with ``strict`` a pipeline sends such rows to :func:`unresolved_models`,
    its error output; the dimension-level check is R3.
    """
    spark = df.sparkSession
    reg = model_registry(spark)
    dim = model_aliases(spark).join(reg, F.col("registry_key") == F.col("key")).drop("key")
    dim = dim.select(*[F.col(c).alias(prefix + c) for c in dim.columns])
    return df.join(F.broadcast(dim), F.col(model_ref) == F.col(prefix + "model_ref"), "left").drop(prefix + "model_ref")


def unresolved_models(df: DataFrame, model_ref: str) -> DataFrame:
    """R2 strict-mode errors: rows whose model reference is not a registry key or alias."""
    spark = df.sparkSession
    return df.join(F.broadcast(model_aliases(spark)), F.col(model_ref) == F.col("model_ref"), "left_anti")


def policy_lint(policy: Policy, spark, aliases: bool = False) -> DataFrame:
    """Policy primary / fallback ids with no registry key (with ``aliases=True``,
    with no key and no alias)."""
    pol = policy_frame(spark, policy)
    ids = pol.select("tier", F.explode(F.array(
        F.struct(F.lit("primary").alias("role"), F.col("policy_model_id").alias("model_id")),
        F.struct(F.lit("fallback").alias("role"), F.col("fallback_model_id").alias("model_id")))).alias("r")
    ).select("tier", "r.role", "r.model_id")
    keys = (model_aliases(spark).select(F.col("model_ref").alias("k")) if aliases
            else model_registry(spark).select(F.col("key").alias("k")))
    return ids.join(F.broadcast(keys), F.col("model_id") == F.col("k"), "left_anti")


def with_cost(df: DataFrame, model_key: str = "model_key", tokens_in: str = "input_tokens",
              tokens_out: str = "output_tokens") -> DataFrame:
    """cost = in_tokens * input price + out_tokens * output price; a row whose model
    is not in the registry stays, with NULL model_id and cost."""
    spark = df.sparkSession
    reg = model_registry(spark).select(F.col("key").alias("_k"), F.col("model_id").alias("model_id"),
                                       "cost_per_input_token", "cost_per_output_token")
    j = df.join(F.broadcast(reg), F.col(model_key) == F.col("_k"), "left")
    return j.select(*df.columns, "model_id",
                    (F.col(tokens_in) * F.col("cost_per_input_token")
                     + F.col(tokens_out) * F.col("cost_per_output_token")).alias("cost"))


def apply_fallback(requests: DataFrame, fallbacks: DataFrame, key: str, failed: str,
                   fields: list[str]) -> DataFrame:
    """When the primary call failed, take the fallback response's ``fields``,
    set tier 3 and confidence 1.0.  ``fallbacks`` has ``key`` and ``fields``.  A failed
    call without a fallback row was not served: all ``fields`` are NULL (error state)."""
    fb = fallbacks.select(key, *[F.col(f).alias("_fb_" + f) for f in fields], F.lit(True).alias("_fb"))
    j = requests.join(fb, key, "left")
    used = F.col(failed) & F.coalesce("_fb", F.lit(False))
    out = [F.when(F.col(failed), F.col("_fb_" + f)).otherwise(F.col(f)).alias(f) for f in fields]
    return j.select(*[c for c in requests.columns if c not in fields], *out,
                    used.alias("used_fallback"))


def initial_log_values(df: DataFrame, tier: str, routed_model: str, primary_model: str) -> DataFrame:
    """Quality 4.5 when the final tier is 3 else NULL; escalated when the final
    tier is 3 and the serving model is not the policy primary."""
    t3 = F.col(tier) == C.FALLBACK_TIER
    return df.select("*",
                     F.when(t3, F.lit(C.TIER3_INITIAL_QUALITY)).otherwise(F.lit(None).cast("double"))
                      .alias("initial_quality_score"),
                     (t3 & (F.col(routed_model) != F.col(primary_model))).cast("int").alias("initial_was_escalated"))


def completion_facts(df: DataFrame, tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    """Usage totals next to the model, tier, cost and confidence."""
    return df.select("*", (F.col(tokens_in) + F.col(tokens_out)).alias("total_tokens"))


def verification_queue(df: DataFrame, tier: str) -> DataFrame:
    """Requests below tier 3 are verified against the gold model.  The gold model
    is one configuration entry, attached as literal columns (no join)."""
    key, provider, model_id, *_ = registry_entry(C.GOLD_MODEL_KEY)
    return df.where(F.col(tier) < C.FALLBACK_TIER).select(
        "*", F.lit(key).alias("gold_model_key"), F.lit(model_id).alias("gold_model_id"),
        F.lit(provider).alias("gold_provider"))


def retry_eligible(status: Column | str, policy: Policy) -> Column:
    """An HTTP status that the runtime policy lists for fallback."""
    s = F.col(status) if isinstance(status, str) else status
    return F.array_contains(F.array(*[F.lit(c) for c in policy.fallback_on_http_codes]), s)


def unresolved_traffic(df: DataFrame, model_ref: str) -> DataFrame:
    """R2's error output as a report: model references that resolve to nothing, with their rows."""
    return unresolved_models(df, model_ref).groupBy(F.col(model_ref).alias("model_ref")).agg(F.count(F.lit(1)).alias("rows"))


def attempt_chains(attempts: DataFrame, policy: Policy, key: str = "request_id", attempt: str = "attempt", status: str = "status",
                   latency: str = "latency_seconds") -> DataFrame:
    """R5 / R9 over the attempts of each request, under the runtime policy.

    A request may be tried ``1 + retry_attempts`` times, attempts counting from 1; later ones
    and those without a number are ignored.  An attempt succeeds with a status from 200 to 299
    within ``timeout_seconds``.  It may be followed by another one if it was late, got no
    answer or got a status that the policy lists; any other status ends the chain.  Per request:

    * ``outcome``: 'served' by the first success, 'refused' by a status that is not retried,
      'exhausted' after the last attempt, or 'open' if more attempts are allowed;
    * ``decided_at`` (the attempt that decided it, NULL while open), ``final_status`` of that
      attempt (NULL: no answer), ``n_late``, ``n_attempts`` (both of the attempts that count) and
      ``use_fallback``: the chain is exhausted.

    One aggregate with partial minima, one column per allowed attempt: attempts of a request are
    never sorted or gathered, and of repeated rows of one attempt the best one counts.
    """
    allowed = 1 + policy.retry_attempts
    late = F.coalesce(F.col(latency) > policy.timeout_seconds, F.lit(False))
    good = F.coalesce(F.col(status).between(200, 299), F.lit(False)) & ~late
    again = late | F.col(status).isNull() | F.coalesce(retry_eligible(status, policy), F.lit(False))
    seen = F.struct(F.when(good, 0).when(again, 1).otherwise(2).alias("rank"), late.alias("late"), F.col(status).alias("status"))
    per = attempts.groupBy(key).agg(*[F.min(F.when(F.col(attempt) == i, seen)).alias(f"_a{i}") for i in range(1, allowed + 1)])
    tried = F.array(*[F.when(F.col(f"_a{i}").isNotNull(), F.struct(F.lit(i).alias("n"), F.col(f"_a{i}").alias("a"))) for i in range(1, allowed + 1)])
    per = per.select(key, F.filter(tried, lambda x: x.isNotNull()).alias("_tried"))
    per = per.withColumn("_end", F.get(F.filter("_tried", lambda x: x["a"]["rank"] != 1), F.lit(0)))
    per = per.withColumn("_last", F.get(F.filter("_tried", lambda x: x["n"] == allowed), F.lit(0)))
    ended, exhausted = F.col("_end").isNotNull(), F.col("_end").isNull() & F.col("_last").isNotNull()
    decided = F.coalesce("_end", "_last")
    counted = F.filter("_tried", lambda x: decided.isNull() | (x["n"] <= decided["n"]))
    return per.select(
        key, F.when(ended & (F.col("_end.a.rank") == 0), "served").when(ended, "refused").when(exhausted, "exhausted").otherwise("open").alias("outcome"),
        decided["n"].alias("decided_at"), decided["a"]["status"].alias("final_status"), F.size(counted).cast("long").alias("n_attempts"),
        F.size(F.filter(counted, lambda x: x["a"]["late"])).cast("long").alias("n_late"), exhausted.alias("use_fallback"))
