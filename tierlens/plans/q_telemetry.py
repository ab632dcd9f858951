"""Dashboard queries (T1-T10) over the request log."""

from __future__ import annotations

from .. import fixtures as fx_
from ..operators import telemetry as T
from ..session import scratch_path
from ..sources import logs as L
from ..streaming import compaction as CO
from ..streaming import dashboard_view as DV
from . import oracle as O
from .registry import ORACLE, register

_BASELINE_SQL = ("CASE WHEN contains(lower(routed_model), 'gpt-4o-mini') THEN cost * 25.0 "
                 "WHEN contains(lower(routed_model), 'haiku') OR contains(lower(routed_model), 'llama') "
                 "THEN cost * 30.0 ELSE cost END")
_M = "DECIMAL(20,10)"


def _logs_sql(body: str) -> str:
    return O.with_ctes(body, **O.fx("request_logs"))


# --------------------------------------------------------------------------- H. telemetry
@register("t1_t3_enriched_log", _logs_sql(f"""
SELECT *, CAST(timestamp AS DATE) AS day, CAST(date_trunc('week', timestamp) AS DATE) AS week,
  {_BASELINE_SQL} AS gpt4o_baseline_cost
FROM request_logs"""))
def q_enriched(spark, sf_dir):
    return T.enrich(fx_.request_logs(spark, sf_dir))


_KPI_SQL = f"""
SELECT count(*) AS requests, CAST(coalesce(sum(CAST(cost AS {_M})), 0) AS DOUBLE) AS actual_spend,
  CAST(coalesce(sum(CAST(b AS {_M})), 0) AS DOUBLE) AS baseline_spend,
  CAST(coalesce(sum(CAST(b AS {_M})), 0) - coalesce(sum(CAST(cost AS {_M})), 0) AS DOUBLE) AS net_savings,
  CASE WHEN CAST(coalesce(sum(CAST(b AS {_M})), 0) AS DOUBLE) > 0
       THEN CAST(coalesce(sum(CAST(b AS {_M})), 0) - coalesce(sum(CAST(cost AS {_M})), 0) AS DOUBLE)
            / CAST(coalesce(sum(CAST(b AS {_M})), 0) AS DOUBLE) * 100.0
       ELSE 0.0 END AS savings_pct
FROM (SELECT cost, {_BASELINE_SQL} AS b FROM request_logs {{where}})"""


@register("t4_headline_kpis", _logs_sql(_KPI_SQL.format(where="")))
def q_kpis(spark, sf_dir):
    return T.headline_kpis(fx_.request_logs(spark, sf_dir))


@register("t10_kpis_tier_without_traffic",
          _logs_sql(_KPI_SQL.format(where="WHERE complexity_tier_assigned > 3")))
def q_kpis_empty(spark, sf_dir):
    """The KPI panel for a tier filter that selects no traffic returns zeros."""
    logs = fx_.request_logs(spark, sf_dir)
    return T.headline_kpis(logs.where(logs.complexity_tier_assigned > 3))


def _spend_sql(key_sql: str, name: str) -> str:
    return _logs_sql(f"""
SELECT {key_sql} AS {name}, CAST(sum(CAST(cost AS {_M})) AS DOUBLE) AS cost,
  CAST(sum(CAST({_BASELINE_SQL} AS {_M})) AS DOUBLE) AS gpt4o_baseline_cost
FROM request_logs WHERE timestamp IS NOT NULL GROUP BY 1""")


@register("t5_daily_spend", _spend_sql("CAST(timestamp AS DATE)", "day"))
def q_daily(spark, sf_dir):
    return T.spend_by(fx_.request_logs(spark, sf_dir), "day")


@register("t6_weekly_spend", _spend_sql("CAST(date_trunc('week', timestamp) AS DATE)", "week"))
def q_weekly(spark, sf_dir):
    return T.spend_by(fx_.request_logs(spark, sf_dir), "week")


@register("t7_model_mix", _logs_sql("""
SELECT routed_model, count(*) AS request_count,
  CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM request_logs WHERE routed_model IS NOT NULL) * 100.0 AS share_pct
FROM request_logs WHERE routed_model IS NOT NULL GROUP BY routed_model
ORDER BY request_count DESC, routed_model"""))
def q_mix(spark, sf_dir):
    return T.model_mix(fx_.request_logs(spark, sf_dir))


@register("t8_quality_histogram", _logs_sql(f"""
, counts AS (
  SELECT CAST(CASE WHEN quality_score < 1 THEN -1 WHEN quality_score > 5.0 THEN 20
         ELSE least(floor((CAST(quality_score AS {_M}) - 1) * 5), 19) END AS INTEGER) AS bin, count(*) AS n
  FROM request_logs WHERE quality_score IS NOT NULL AND NOT isnan(quality_score) GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT coalesce(s.bin, c.bin) AS bin,
  CAST(1 + coalesce(s.bin, c.bin) * CAST(0.2 AS DECIMAL(3,1)) AS DOUBLE) AS bin_start,
  CAST(1 + (coalesce(s.bin, c.bin) + 1) * CAST(0.2 AS DECIMAL(3,1)) AS DOUBLE) AS bin_end,
  CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM spine s FULL OUTER JOIN counts c ON s.bin = c.bin"""))
def q_hist(spark, sf_dir):
    return T.quality_histogram(fx_.request_logs(spark, sf_dir))


@register("t8_data_histogram", _logs_sql("""
, q AS (SELECT CAST(round(quality_score * 1e10) AS HUGEINT) AS q FROM request_logs WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)),
m AS (SELECT min(q) AS lo, max(q) AS hi FROM q),
b AS (SELECT lo, hi, (hi - lo) / 20.0 AS rough, CAST(pow(10, floor(log10((hi - lo) / 20.0))) AS HUGEINT) AS base FROM m),
s AS (SELECT lo, hi, base * CASE WHEN base >= rough THEN 1 WHEN base * 2 >= rough THEN 2 WHEN base * 5 >= rough THEN 5 ELSE 10 END AS step FROM b),
e AS (SELECT hi, step, lo // step * step AS start, greatest(1, (hi - lo // step * step + step - 1) // step) AS n FROM s),
c AS (SELECT least((q - start) // step, n - 1) AS bin, count(*) AS k FROM q, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, CAST((start + i * step) / 1e10 AS DOUBLE) AS bin_start, CAST((start + (i + 1) * step) / 1e10 AS DOUBLE) AS bin_end,
  coalesce(k, 0) AS count
FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS i, start, step FROM e) LEFT JOIN c ON c.bin = i"""))
def q_data_hist(spark, sf_dir):
    """T8 with up to 20 bins whose edges come from the data."""
    return T.data_histogram(fx_.request_logs(spark, sf_dir))


@register("t9_daily_escalation", _logs_sql("""
SELECT CAST(timestamp AS DATE) AS day, count(id) AS total_count, CAST(coalesce(sum(was_escalated), 0) AS BIGINT) AS escalated_count,
  CAST(coalesce(sum(was_escalated), 0) AS DOUBLE) / CAST(count(id) AS DOUBLE) * 100.0 AS escalation_rate_pct
FROM request_logs WHERE timestamp IS NOT NULL GROUP BY 1"""))
def q_esc(spark, sf_dir):
    return T.escalation_rate(fx_.request_logs(spark, sf_dir))


# --------------------------------------------------------------------------- T4-T9 from the maintained view
def _view(spark, sf_dir):
    """The log in two appends, compacted and refreshed after each."""
    records, log = fx_.telemetry_records(spark, sf_dir), scratch_path(spark, "view-log")
    for part in (0, 1):
        L.append_request_telemetry(records.where(records.id % 2 == part), log)
        CO.compact(spark, log, f"{log}_verdicts")
        DV.refresh(spark, log)
    return DV.read_partials(spark, log)


_SUMS = f"""count(*) AS requests, CAST(sum(CAST(cost AS {_M})) AS DOUBLE) AS cost, CAST(sum(CAST(b AS {_M})) AS DOUBLE) AS gpt4o_baseline_cost,
  CAST(sum(CAST(b AS {_M})) - sum(CAST(cost AS {_M})) AS DOUBLE) AS net_savings,
  CASE WHEN CAST(sum(CAST(b AS {_M})) AS DOUBLE) > 0 THEN CAST(sum(CAST(b AS {_M})) - sum(CAST(cost AS {_M})) AS DOUBLE)
       / CAST(sum(CAST(b AS {_M})) AS DOUBLE) * 100.0 ELSE 0.0 END AS savings_pct,
  CAST(sum(was_escalated) AS BIGINT) AS escalated_count, CAST(sum(was_escalated) AS DOUBLE) / CAST(count(id) AS DOUBLE) * 100.0 AS escalation_rate_pct"""


@register("t4_t9_spend_view", _logs_sql(f"""
, e AS (SELECT *, CAST(timestamp AS DATE) AS day, CAST(date_trunc('week', timestamp) AS DATE) AS week, {_BASELINE_SQL} AS b FROM request_logs)
SELECT 'day' AS grain, day AS period, {_SUMS} FROM e GROUP BY day
UNION ALL SELECT 'week', week, {_SUMS} FROM e GROUP BY week
UNION ALL SELECT 'total', NULL, {_SUMS} FROM e"""))
def q_view_spend(spark, sf_dir):
    return DV.spend_and_escalation(_view(spark, sf_dir))


@register("t7_model_mix_view", ORACLE["t7_model_mix"])
def q_view_mix(spark, sf_dir):
    return DV.model_mix(_view(spark, sf_dir))


@register("t8_quality_histogram_view", ORACLE["t8_quality_histogram"])
def q_view_hist(spark, sf_dir):
    return DV.quality_histogram(_view(spark, sf_dir))
