"""Deterministic fixture views over the input tables (FIXTURES.md section 2).

Each builder reads whole tables and derives the shapes the operators consume.
The same views are written in DuckDB SQL in ``tierlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_logs`` (tier mix 60/30/10, NULL scores, escalations) from ``events``."""
    return _logs(read(spark, sf_dir, "events"), raw=False)


def _logs(ev: DataFrame, raw: bool) -> DataFrame:
    # one SQL projection (a single call into the JVM to build it)
    prompt = "concat('u', CAST(user_id AS STRING))"
    err_esc = "(event_type = 'error' AND event_id % 4 = 0)"
    escalated = f"CASE WHEN event_id % 10 < 9 AND {err_esc} THEN 1 ELSE 0 END"
    return ev.selectExpr(
        "event_id AS id",
        "ts AS timestamp",
        f"{prompt} AS prompt" if raw else f"sha2({prompt}, 256) AS prompt_hash",
        "CASE WHEN event_id % 10 < 6 THEN 1 WHEN event_id % 10 < 9 THEN 2 ELSE 3 END AS complexity_tier_assigned",
        f"CASE WHEN event_id % 10 = 9 THEN 'gpt-4o' WHEN {err_esc} THEN 'gpt-4o (Escalated)' "
        "WHEN event_id % 10 >= 6 THEN 'gpt-4o-mini' WHEN event_id % 10 = 5 THEN 'llama3.1:8b' "
        "ELSE 'claude-3-haiku' END AS routed_model",
        "value / 100000 AS cost",
        "CAST(event_id % 200 AS DOUBLE) / 100 AS latency",
        "CASE WHEN event_id % 10 < 9 AND event_id % 5 = 1 THEN CAST(NULL AS DOUBLE) "
        "ELSE 1 + CAST((event_id * 37) % 401 AS DOUBLE) / 100 END AS quality_score",
        f"({escalated}) = 1 AS was_escalated" if raw else f"{escalated} AS was_escalated",
    )


def telemetry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request records (prompt text, flag as boolean) whose S1 projection is
    exactly ``request_logs``: the prompt of user ``u`` is the text ``'u<id>'``."""
    return _logs(read(spark, sf_dir, "events"), raw=True)


def verification_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap/gold/judge outputs per request, from ``orders`` (verification is CPU-heavy
    per row: JSON and regex work, so the rows are spread over the cores)."""
    o = read(spark, sf_dir, "orders", spread=True)
    # one SQL projection (a single call into the JVM to build it); chr(10) is a
    # newline and chr(39) a single quote
    k, st, pr = "o_orderkey", "o_orderstatus", "o_orderpriority"
    extraction_cheap = (
        f"CASE WHEN {k} % 7 = 0 THEN concat('{{\"name\": \"', {st}, '\", \"amount\": 1, \"date\": \"d\"}}') "
        f"WHEN {k} % 7 = 1 THEN concat('Sure! {{\"name\": \"', {st}, '\",', chr(10), ' \"date\": \"d\", \"amount\": 2}} done') "
        f"WHEN {k} % 7 = 2 THEN concat('{{\"name\": \"', {st}, '\"}}') "
        f"WHEN {k} % 7 = 3 THEN '{{\"name\": 1}} and {{\"date\": 2, \"amount\": 3}}' "
        f"WHEN {k} % 7 = 4 THEN 'no structured output' "
        f"WHEN {k} % 7 = 5 THEN '{{}}' "
        f"ELSE concat('{{', chr(39), 'name', chr(39), ': 1}}') END")
    return o.selectExpr(
        f"{k} AS pair_id",
        f"CASE WHEN {k} % 4 = 0 THEN 'extraction' WHEN {k} % 4 = 1 THEN 'classification' "
        f"WHEN {k} % 4 = 2 THEN 'summarization' ELSE 'translation' END AS task_type",
        f"concat('Order ', CAST({k} AS STRING), ' ', {pr}) AS original_prompt",
        f"CASE WHEN {k} % 4 = 0 THEN {extraction_cheap} WHEN {k} % 5 = 0 THEN 'something else' "
        f"WHEN {k} % 5 = 1 THEN '' ELSE concat('The label is ', upper({pr}), '.') END AS cheap_output",
        f"CASE WHEN {k} % 4 = 0 THEN concat('{{\"name\": \"', {st}, '\", \"date\": \"d\", \"amount\": 1}}') "
        f"ELSE {pr} END AS gold_output",
        f"CASE WHEN {k} % 6 = 0 THEN '{{\"score\": 4, \"reason\": \"ok\"}}' "
        f"WHEN {k} % 6 = 1 THEN '{{\"score\": 3.5}}' "
        f"WHEN {k} % 6 = 2 THEN '{{\"reason\": \"none\"}}' "
        f"WHEN {k} % 6 = 3 THEN 'Score: 5' "
        f"WHEN {k} % 6 = 4 THEN '{{\"score\": \"4.5\", \"reason\": \"str\"}}' "
        f"ELSE '{{\"score\": \"high\", \"reason\": \"bad\"}}' END AS judge_output",
        "o_totalprice / 100000000 AS cheap_cost",
        "o_totalprice / 10000000 AS gold_cost",
        f"CAST(1 + {k} % 2 AS INT) AS predicted_tier",
        f"{k} % 9 = 0 AS primary_failed",
    )


def call_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP status of each provider call, from ``events`` (NULL: no answer)."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 408 WHEN 4 THEN 429 "
        "WHEN 5 THEN 500 WHEN 6 THEN 502 WHEN 7 THEN 503 END AS status")


def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of provider calls, from ``events``: five numbers per request (one of them may be
    missing, repeated or beyond what the policy allows), with every kind of status and latency."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id DIV 5 AS request_id", "CAST(1 + (event_id % 5 + event_id DIV 5 % 3) % 5 AS INT) AS attempt",
        "CASE event_id * 7 % 13 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 400 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 502 WHEN 6 THEN 503 "
        "WHEN 7 THEN 429 WHEN 8 THEN 503 WHEN 9 THEN 500 WHEN 10 THEN 404 END AS status",
        "CASE WHEN event_id % 17 = 3 THEN CAST(NULL AS DOUBLE) ELSE CAST(event_id * 3 % 29 AS DOUBLE) / 2 END AS latency_seconds")


def routing_failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing failures before featurisation: every document, with tiers from its id."""
    return routing_failures_from(read(spark, sf_dir, "documents", spread=True))


def routing_failures_from(d: DataFrame) -> DataFrame:
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("prompt"),
        (1 + F.col("doc_id") % 2).cast("int").alias("assigned_tier"),
        (2 + F.col("doc_id") % 2).cast("int").alias("true_tier"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label/prediction pairs with a known confusion structure, from ``documents``."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    shift = F.when(i % 11 < 2, i % 11 + 1).otherwise(0)
    return d.select(i.alias("id"), (1 + i % 3).cast("int").alias("label"),
                    (1 + (i + shift) % 3).cast("int").alias("prediction"))


def provider_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider payloads (openai / anthropic / ollama / unsupported) from ``lineitem``."""
    return provider_responses_from(read(spark, sf_dir, "lineitem"))


def provider_responses_from(li: DataFrame) -> DataFrame:
    ok = F.col("l_orderkey")
    ln = F.col("l_linenumber").cast("string")
    qty = F.col("l_quantity").cast("int").cast("string")
    openai = F.concat(
        F.lit('{"choices": [{"message": {"content": '),
        F.when(F.col("l_linenumber") == 1, F.lit("null"))
         .otherwise(F.concat(F.lit('" '), F.col("l_returnflag"), F.lit(' "'))),
        F.lit('}}], "usage": {"prompt_tokens": '), qty, F.lit(', "completion_tokens": '), ln, F.lit("}}"))
    anthropic = F.concat(F.lit('{"content": [{"text": "'), F.col("l_linestatus"),
                         F.lit('"}], "usage": {"input_tokens": '), qty,
                         F.lit(', "output_tokens": '), ln, F.lit("}}"))
    ollama = F.concat(
        F.lit('{"message": {"content": "'), F.col("l_returnflag"), F.lit('"}'),
        F.when(F.col("l_linenumber") == 2, F.lit(""))
         .otherwise(F.concat(F.lit(', "prompt_eval_count": '), qty, F.lit(', "eval_count": '), ln)),
        F.lit("}"))
    return li.select(
        (ok * 10 + F.col("l_linenumber")).alias("request_id"),
        F.when(ok % 4 == 0, "OpenAI").when(ok % 4 == 1, "anthropic")
         .when(ok % 4 == 2, "ollama").otherwise("cohere").alias("provider"),
        F.when(ok % 4 == 0, "gpt-4o-mini").when(ok % 4 == 1, "claude-haiku")
         .when(ok % 4 == 2, "local-llama").otherwise("unknown").alias("model_key"),
        F.when(ok % 4 == 0, openai).when(ok % 4 == 1, anthropic)
         .when(ok % 4 == 2, ollama).otherwise(F.lit("{}")).alias("raw_json"),
    )
