"""Request-log and routing-failure tables.

Append-only Parquet, one folder per append: below it the request log is partitioned by
``day`` so dashboard and worker scans prune partitions.  A row that
breaks the NOT NULL / 0-1 rules goes to a reject table instead of failing the job.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import observed
from ..functions.text import prompt_hash
from ..operators.training import featurise_failures
from .ledger import Ledger

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("complexity_tier_assigned", T.IntegerType()),
    T.StructField("routed_model", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("was_escalated", T.IntegerType()),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]
LOG_TABLE_SCHEMA = T.StructType(LOG_SCHEMA.fields + [T.StructField("day", T.DateType())])

FAILURE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("assigned_tier", T.IntegerType()),
    T.StructField("true_tier", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("contains_analyze_compare", T.IntegerType()),
    T.StructField("constraint_count", T.IntegerType()),
    T.StructField("context_provided", T.IntegerType()),
    T.StructField("output_format_complexity", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


#: Costs and their baselines (at most 30 times as much) must fit DECIMAL(20,10).
MAX_COST = 3e8


@contextmanager
def identified(records: DataFrame, path: str, batch: tuple[str, int] | None = None):
    """Yields (records with an ``id``, this append's number, a function to tell the highest id).

    Records that bring ids keep them (a NULL stays NULL and is rejected later) and raise the
    table's ledger above them; others get ids from a range leased for this append, of which
    the unused rest is given back at the end.  The table itself is never read, and appends
    may run at the same time.  ``batch`` (a stream's checkpoint and batch number) makes a
    repeated batch find its own lease again."""
    spark = records.sparkSession
    ledger = Ledger(spark, path)
    brought, least = "id" in records.columns, 0
    if brought:
        top = records.agg(F.max(F.col("id").cast("long"))).first()[0]
        least = 0 if top is None else top + 1
    lease = ledger.lease(least) if batch is None else ledger.lease_of_batch(*batch, least)
    if brought:
        ledger.close(lease, lease.start)
        yield records, lease.number, lambda top: None
        return
    used = []
    yield records.withColumn("id", F.lit(lease.start) + F.monotonically_increasing_id()), lease.number, used.append
    # only reached when the append succeeded: a lost writer keeps its range
    ledger.close(lease, lease.start if not used or used[-1] is None else used[-1] + 1)


def append(rows: DataFrame, path: str, number: int, by: list[str] | None = None, again: bool = False) -> None:
    """Add a numbered append to a table.  Each is a partition folder of its own: writers that
    share a folder would move and clean up each other's files while they commit.  ``again``:
    a batch of a stream, which replaces what an earlier try of it has written."""
    rows.write.mode("overwrite" if again else "errorifexists").partitionBy(*(by or [])).parquet(f"{path.rstrip('/')}/append={number}")


def telemetry_projection(records: DataFrame) -> DataFrame:
    """S1 row logic: hash the prompt, flag -> 0/1, default timestamp, day column and
    a validity flag (an id, NOT NULL columns, flag in {0, 1}, a cost that money sums can hold)."""
    cols = set(records.columns)
    ts = F.col("timestamp").cast("timestamp_ntz") if "timestamp" in cols else F.lit(None).cast("timestamp_ntz")
    ts = F.coalesce(ts, F.localtimestamp())
    # booleans and 0/1 integers map to 0/1, a missing flag is 0; anything else is rejected
    flag = F.coalesce(F.col("was_escalated").cast("string"), F.lit("0"))
    flag01 = F.when(flag.isin("true", "1"), 1).when(flag.isin("false", "0"), 0)
    out = records.select(
        F.col("id").cast("long").alias("id"), ts.alias("timestamp"), prompt_hash("prompt").alias("prompt_hash"),
        F.col("complexity_tier_assigned").cast("int").alias("complexity_tier_assigned"),
        F.col("routed_model").cast("string").alias("routed_model"),
        F.col("cost").cast("double").alias("cost"), F.col("latency").cast("double").alias("latency"),
        F.col("quality_score").cast("double").alias("quality_score"),
        flag01.cast("int").alias("was_escalated"))
    valid = F.lit(True)
    for c in ["id", "prompt_hash", "complexity_tier_assigned", "routed_model", "cost", "latency", "was_escalated"]:
        valid = valid & F.col(c).isNotNull()
    valid = valid & ~F.isnan("cost") & (F.abs("cost") < MAX_COST)
    return out.select("*", F.to_date("timestamp").alias("day"), valid.alias("_valid"))


def append_request_telemetry(records: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Append valid rows to ``path`` (partitioned by day), rejects to ``path_rejects``.

    The rows are projected and written in one pass that also counts the rejects; only an
    append that has some reads its records again for them.  Each write is a plain append,
    so a retried task never duplicates committed files.  ``batch``: see :func:`identified`.
    """
    with identified(records, path, batch) as (numbered, number, written):
        proj = telemetry_projection(numbered)
        # a rebalance puts a day's rows together, in files of the advisory size
        got = observed(proj, {"rejects": F.count_if(~F.col("_valid")), "top": F.max("id")},
                       lambda rows: append(rows.where("_valid").drop("_valid").hint("rebalance", "day"), path, number, ["day"], batch is not None))
        written(got["top"])
        if got["rejects"]:
            append(proj.where(~F.col("_valid")).drop("_valid"), path.rstrip("/") + "_rejects", number, again=batch is not None)


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet scan with a fixed schema; a table that does not exist yet reads as empty.
    Appends that were not finished are invisible (their files are not committed)."""
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.schema(schema).parquet(path)
        return df.select(*schema.fieldNames()) if isinstance(schema, T.StructType) else df   # without the append's number
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def scan_request_log(spark: SparkSession, path: str) -> DataFrame:
    """S3: the whole request log (``day`` is the partition column; filters on it prune)."""
    return scan(spark, path, LOG_TABLE_SCHEMA)


def failure_projection(events: DataFrame) -> DataFrame:
    """S2 row logic: D14 features with the fixed defaults and a default timestamp."""
    f = featurise_failures(events)
    ts = F.col("timestamp") if "timestamp" in events.columns else F.lit(None)
    return f.select(*[c for c in f.columns],
                    F.coalesce(ts.cast("timestamp_ntz"), F.localtimestamp()).alias("timestamp"))


def append_routing_failures(events: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Featurise and append failure rows (prompt, assigned_tier, true_tier; optional id).
    Rows that bring a NULL id go to ``path_rejects``."""
    with identified(events, path, batch) as (numbered, number, written):
        rows = failure_projection(numbered).select([f.name for f in FAILURE_SCHEMA.fields])
        got = observed(rows, {"rejects": F.count_if(F.col("id").isNull()), "top": F.max("id")},
                       lambda df: append(df.where("id IS NOT NULL"), path, number, again=batch is not None))
        written(got["top"])
        if got["rejects"]:
            append(rows.where("id IS NULL"), path.rstrip("/") + "_rejects", number, again=batch is not None)


def scan_routing_failures(spark: SparkSession, path: str) -> DataFrame:
    """All failures; a missing table reads as empty (never an error)."""
    return scan(spark, path, FAILURE_SCHEMA)
