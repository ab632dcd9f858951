"""T4-T9 as one maintained view: daily partials that only changed days recompute.

A day's partials are sums and counts by (routed model, quality bin), a few hundred rows at
most for any traffic; every panel is a further sum of them, so days, weeks and the total
come from the same table by grouping sets.  Money stays decimal until the last step.

Changes are tracked by partition: the compacted log (:mod:`.compaction`) has one folder
version per day, and the view remembers which version of a day it has summed.
:func:`refresh` reads the folders of the days whose version has changed, no others, and
publishes the new state as one numbered file, after the partials are written.  The view
shows the log as of its last compaction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import money
from ..operators.telemetry import baseline_cost_col, histogram_of, quality_bin
from ..sources.shared_files import Sequence
from .compaction import EMPTY, base_days, base_rows, read_folders

#: ``cost_dec`` and ``b_dec`` hold sums of DECIMAL(20,10) values.
PARTIALS = "routed_model string, bin int, n long, n_id long, cost_dec decimal(30,10), b_dec decimal(30,10), escalated long, day date"


def partials(logs: DataFrame) -> DataFrame:
    """Mergeable sums per (day, routed model, quality bin)."""
    rows = logs.select("day", "routed_model", quality_bin().alias("bin"), "id", "cost", baseline_cost_col().alias("b"), "was_escalated")
    return rows.groupBy("day", "routed_model", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("n_id"), F.sum(money("cost")).cast("decimal(30,10)").alias("cost_dec"),
        F.sum(money("b")).cast("decimal(30,10)").alias("b_dec"), F.sum("was_escalated").cast("long").alias("escalated"))


def _views(spark: SparkSession, log: str) -> Sequence:
    return Sequence(spark, log.rstrip("/") + "_current", "view")


def _root(log: str) -> str:
    return log.rstrip("/") + "_current/partials"


def refresh(spark: SparkSession, log: str) -> list[str]:
    """Recompute the days whose base has changed; returns them (also none)."""
    views = _views(spark, log)
    n = views.last()
    have = EMPTY["days"] if n < 0 else views.read(n)["days"]
    now = base_days(spark, log)
    stale = {d: v for d, v in now.items() if have.get(d, [None])[0] != v}
    if not stale:
        return []
    version = uuid.uuid4().hex[:12]
    partials(base_rows(spark, log, stale)).write.partitionBy("day").parquet(f"{_root(log)}/v={version}")
    kept = {d: x for d, x in have.items() if d in now}
    if not views.offer(n + 1, {"days": kept | {d: [v, version] for d, v in stale.items()}}):
        return refresh(spark, log)                  # somebody else refreshed: start from there
    return sorted(stale)


def read_partials(spark: SparkSession, log: str) -> DataFrame:
    views = _views(spark, log)
    n = views.last()
    days = {} if n < 0 else views.read(n)["days"]
    return read_folders(spark, PARTIALS, _root(log), [f"v={v}/day={d}" for d, (_, v) in sorted(days.items())])


def spend_and_escalation(parts: DataFrame) -> DataFrame:
    """T4, T5, T6 and T9 in one pass: per grain ('day', 'week', 'total') and period the requests,
    spend, baseline spend, savings and escalations."""
    p = parts.withColumn("week", F.to_date(F.date_trunc("week", F.col("day"))))
    sums = [F.sum("n").alias("requests"), F.sum("n_id").alias("n_id"), F.sum("cost_dec").alias("c"), F.sum("b_dec").alias("b"),
            F.sum("escalated").alias("escalated"), F.grouping_id().alias("g")]
    g = p.groupingSets([["day"], ["week"], []], "day", "week").agg(*sums)
    grain = F.when(F.col("g") == 1, "day").when(F.col("g") == 2, "week").otherwise("total")
    dec = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,10)"))
    net, base = (dec("b") - dec("c")).cast("double"), dec("b").cast("double")
    return g.select(grain.alias("grain"), F.coalesce("day", "week").alias("period"), F.coalesce("requests", F.lit(0)).cast("long").alias("requests"),
                    dec("c").cast("double").alias("cost"), base.alias("gpt4o_baseline_cost"), net.alias("net_savings"),
                    F.when(base > 0, net / base * F.lit(100.0)).otherwise(F.lit(0.0)).alias("savings_pct"),
                    F.coalesce("escalated", F.lit(0)).cast("long").alias("escalated_count"),
                    (F.coalesce("escalated", F.lit(0)).cast("double") / F.col("n_id").cast("double") * F.lit(100.0)).alias("escalation_rate_pct"))


def model_mix(parts: DataFrame) -> DataFrame:
    """T7 from the partials."""
    m = parts.where(F.col("routed_model").isNotNull())
    total = m.select(F.sum("n").cast("double")).scalar()
    return (m.groupBy("routed_model").agg(F.sum("n").alias("request_count"))
            .select("routed_model", "request_count", (F.col("request_count").cast("double") / total * F.lit(100.0)).alias("share_pct"))
            .orderBy(F.col("request_count").desc(), F.col("routed_model")))


def quality_histogram(parts: DataFrame) -> DataFrame:
    """T8 from the partials."""
    return histogram_of(parts.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")))
