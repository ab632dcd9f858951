"""Spend, routing-mix, quality and escalation analytics over the request log.

Plan shape: one scan with column pruning -> one shared projection (T1-T3) ->
partial (map-side) aggregation per panel.  Group keys are days, weeks or model
names; a hot key is pre-aggregated on the map side before the shuffle, so no
single task ever sees all rows of a key.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BASELINE_RULES
from ..functions.money import MONEY, money, money_sum
from ..functions.text import contains_any


def day_col(ts: str = "timestamp") -> Column:
    """Calendar day of the (naive, UTC) timestamp."""
    return F.to_date(F.col(ts))


def week_col(ts: str = "timestamp") -> Column:
    """Monday that starts the week."""
    return F.to_date(F.date_trunc("week", F.col(ts)))


def baseline_cost_col(model: str = "routed_model", cost: str = "cost") -> Column:
    """What the request would have cost on the top model (rules checked in order)."""
    lower = F.lower(F.col(model))
    expr = None
    for keywords, mult in BASELINE_RULES:
        cond = contains_any(lower, keywords)
        val = F.col(cost) * F.lit(mult)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.col(cost))


def enrich(logs: DataFrame) -> DataFrame:
    """T1-T3 in one projection."""
    return logs.select("*", day_col().alias("day"), week_col().alias("week"),
                       baseline_cost_col().alias("gpt4o_baseline_cost"))


def headline_kpis(logs: DataFrame) -> DataFrame:
    """T4 (and T10: an empty log gives zeros, never an error)."""
    e = logs.select("cost", baseline_cost_col().alias("b"))
    agg = e.agg(F.count(F.lit(1)).alias("requests"),
                F.coalesce(F.sum(money("cost")), F.lit(0).cast(MONEY)).alias("a"),
                F.coalesce(F.sum(money("b")), F.lit(0).cast(MONEY)).alias("bl"))
    actual = F.col("a").cast("double")
    base = F.col("bl").cast("double")
    net = (F.col("bl") - F.col("a")).cast("double")
    return agg.select(
        "requests", actual.alias("actual_spend"), base.alias("baseline_spend"),
        net.alias("net_savings"),
        F.when(base > 0, net / base * F.lit(100.0)).otherwise(F.lit(0.0)).alias("savings_pct"))


def spend_by(logs: DataFrame, grain: str) -> DataFrame:
    """T5 (grain 'day') / T6 (grain 'week'): actual vs baseline spend per period; rows
    without a timestamp belong to no period."""
    key = {"day": day_col(), "week": week_col()}[grain].alias(grain)
    return (logs.select(key, "cost", baseline_cost_col().alias("b")).where(F.col(grain).isNotNull())
            .groupBy(grain)
            .agg(money_sum("cost").alias("cost"), money_sum("b").alias("gpt4o_baseline_cost")))


def model_mix(logs: DataFrame) -> DataFrame:
    """Requests per routed model, share of all requests, largest first.

    The total is a scalar subquery (one small job, inlined as a value): no cross
    join and no single-partition window.
    """
    m = logs.select("routed_model").where(F.col("routed_model").isNotNull())
    total = m.select(F.count(F.lit(1)).cast("double")).scalar()
    return (m.groupBy("routed_model").agg(F.count(F.lit(1)).alias("request_count"))
            .select("routed_model", "request_count",
                    (F.col("request_count").cast("double") / total * F.lit(100.0)).alias("share_pct"))
            .orderBy(F.col("request_count").desc(), F.col("routed_model")))


HIST_BINS = 20
HIST_LO = 1
HIST_WIDTH = "0.2"


def quality_bin(score: str = "quality_score") -> Column:
    """T8's bin of a score, in exact decimal arithmetic: -1 below 1, 20 above 5, NULL for no
    score or NaN."""
    q = F.col(score)
    b = (F.when(q < HIST_LO, F.lit(-1))
          .when(q > HIST_LO + HIST_BINS * float(HIST_WIDTH), F.lit(HIST_BINS))
          .otherwise(F.least(F.floor((q.try_cast(MONEY) - F.lit(HIST_LO)) * F.lit(int(1 / float(HIST_WIDTH)))),
                             F.lit(HIST_BINS - 1))).cast("int"))
    return F.when(q.isNotNull() & ~F.isnan(q), b)


def histogram_of(counts: DataFrame) -> DataFrame:
    """T8's table from (bin, n), joined to a 20-row spine so empty bins show a zero count."""
    spine = counts.sparkSession.range(HIST_BINS).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(counts, "bin", "full_outer")
    width = F.expr(f"CAST({HIST_WIDTH} AS DECIMAL(3,1))")
    return out.select(
        "bin",
        (F.lit(HIST_LO) + F.col("bin") * width).cast("double").alias("bin_start"),
        (F.lit(HIST_LO) + (F.col("bin") + 1) * width).cast("double").alias("bin_end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"))


def quality_histogram(logs: DataFrame) -> DataFrame:
    """20 bins of 0.2 on [1, 5] (5.0 in the last bin), NULL scores left out.

    Scores below 1 go to bin -1, above 5 to bin 20 (rows only if such scores exist).
    """
    return histogram_of(logs.select(quality_bin().alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


#: T8 with bins from the data: this many at most, besides one for the alignment of the first edge.
MAX_BINS = 20


def nice_step(lo: Decimal, hi: Decimal, bins: int = MAX_BINS) -> Decimal:
    """The least of 1, 2 or 5 times a power of ten that cuts lo..hi into at most ``bins``."""
    rough = (hi - lo) / bins
    if rough <= 0:
        return Decimal(1)
    base = Decimal(10) ** rough.adjusted()            # the power of ten at or below it
    return next(base * m for m in (1, 2, 5, 10) if base * m >= rough)


def data_histogram(logs: DataFrame, bins: int = MAX_BINS) -> DataFrame:
    """T8 with edges from the data: (bin, bin_start, bin_end, count) from the least to the greatest
    score in nice steps, edges at multiples of the step, the greatest score in the last bin.

    Two passes over one column: least and greatest (one row), then counts per bin; empty bins
    have a zero count.  NULL and NaN scores and those beyond the money type are left out; one
    score makes one bin, none an empty table.  Exact decimal arithmetic throughout."""
    q = F.when(~F.isnan("quality_score"), F.col("quality_score").try_cast(MONEY))
    scores = logs.select(q.alias("q")).where("q IS NOT NULL")
    lo, hi = scores.agg(F.min("q"), F.max("q")).first()
    spark = logs.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    step = nice_step(lo, hi, bins)
    start = (lo / step).to_integral_value(ROUND_FLOOR) * step
    n = max(1, int(((hi - start) / step).to_integral_value(ROUND_CEILING)))
    wide = lambda d: F.lit(str(d)).cast("decimal(30,10)")
    at = F.least(F.call_function("div", F.col("q") - wide(start), wide(step)), F.lit(n - 1).cast("long")).cast("int")
    counts = scores.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: (wide(start) + i.cast("decimal(10,0)") * wide(step)).cast("double")
    return spine.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
                                                    F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def quality_quantiles(logs: DataFrame, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(share, score) from a mergeable sketch: a score's rank is off by at most rows / ``accuracy``."""
    q = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    sketch = logs.agg(F.percentile_approx(q, [float(x) for x in shares], accuracy).alias("s"))
    return sketch.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(x)) for x in shares]).alias("share"), F.col("s").alias("score")))).toDF("share", "score")


def escalation_rate(logs: DataFrame) -> DataFrame:
    """Per day, requests, escalations and the escalation rate in percent (rows without
    a timestamp belong to no day)."""
    g = (logs.select(day_col().alias("day"), "id", "was_escalated").where("day IS NOT NULL").groupBy("day")
         .agg(F.count("id").alias("total_count"),
              F.coalesce(F.sum("was_escalated"), F.lit(0)).cast("long").alias("escalated_count")))
    return g.select("day", "total_count", "escalated_count",
                    (F.col("escalated_count").cast("double") / F.col("total_count").cast("double")
                     * F.lit(100.0)).alias("escalation_rate_pct"))
