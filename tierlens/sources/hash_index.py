"""An index of the request log by prompt hash.

Entries (prompt hash, id, day, routed model, timestamp) lie in partitions by the hash's first
``DIGITS`` hexadecimal digits, sorted by hash inside each file, so looking up k hashes reads
at most k of 16^DIGITS partitions, and inside them the row groups whose hash range fits.
:func:`update` adds what the index lacks, append by append, and publishes which appends
it holds as a numbered file (:mod:`.shared_files`): a lookup sees whole updates only, and an
update that dies leaves an unused folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import LOG_TABLE_SCHEMA, scan
from .shared_files import Sequence, exists, names

DIGITS = 3
#: Hashes that a lookup takes as literals; longer lists are joined.
LITERALS = 10_000
ENTRY = "prompt_hash string, id long, day date, routed_model string, timestamp timestamp_ntz, prefix string"
COLUMNS = ["prompt_hash", "id", "day", "routed_model", "timestamp"]


def _root(log: str) -> str:
    return log.rstrip("/") + "_by_hash"


def _state(spark: SparkSession, log: str) -> tuple[Sequence, int, dict]:
    sequence = Sequence(spark, _root(log), "holds")
    n = sequence.last()
    return sequence, n, {"appends": [], "folders": []} if n < 0 else sequence.read(n)


def update(spark: SparkSession, log: str) -> int:
    """Index the finished appends that are not indexed yet; returns how many."""
    sequence, n, state = _state(spark, log)
    found = [x for x in names(spark, log) if x.startswith("append=") and exists(spark, f"{log.rstrip('/')}/{x}/_SUCCESS")]
    new = sorted(set(found) - set(state["appends"]))
    if not new:
        return 0
    rows = spark.read.schema(LOG_TABLE_SCHEMA).option("basePath", log).parquet(*[f"{log.rstrip('/')}/{x}" for x in new])
    version = f"v={uuid.uuid4().hex[:12]}"
    entries = rows.select(*COLUMNS, F.substring("prompt_hash", 1, DIGITS).alias("prefix"))
    # a rebalance puts a prefix's entries together and splits one that a hot prompt fills
    (entries.hint("rebalance", "prefix").sortWithinPartitions("prefix", "prompt_hash")
     .write.partitionBy("prefix").parquet(f"{_root(log)}/{version}"))
    if not sequence.offer(n + 1, {"appends": sorted(set(state["appends"]) | set(new)), "folders": [*state["folders"], version]}):
        return update(spark, log)                       # another update came first: index what is left
    return len(new)


def entries(spark: SparkSession, log: str) -> DataFrame:
    """All entries of the index."""
    _, _, state = _state(spark, log)
    if not state["folders"]:
        return spark.createDataFrame([], ENTRY)
    root = _root(log)
    return spark.read.schema(ENTRY).option("basePath", root).parquet(*[f"{root}/{x}" for x in state["folders"]]).select(*COLUMNS, "prefix")


def lookup(spark: SparkSession, log: str, hashes: list[str]) -> DataFrame:
    """Entries of these hashes: partitions by prefix, then row groups, then rows are left out."""
    known = sorted(set(hashes))
    if len(known) > LITERALS:
        raise ValueError(f"more than {LITERALS} hashes: use lookup_table")
    prefixes = sorted({h[:DIGITS] for h in known})
    return entries(spark, log).where(F.col("prefix").isin(prefixes) & F.col("prompt_hash").isin(known)).select(*COLUMNS)


def lookup_table(spark: SparkSession, log: str, hashes: DataFrame, column: str = "prompt_hash") -> DataFrame:
    """Entries of the hashes in a table of any length: a semi join."""
    wanted = hashes.select(F.col(column).alias("prompt_hash"), F.substring(column, 1, DIGITS).alias("prefix"))
    return entries(spark, log).join(wanted, ["prefix", "prompt_hash"], "left_semi").select(*COLUMNS)


def lookup_scan(spark: SparkSession, log: str, hashes: list[str]) -> DataFrame:
    """The same without the index, for logs that have none."""
    return scan(spark, log, LOG_TABLE_SCHEMA).where(F.col("prompt_hash").isin(sorted(set(hashes)))).select(*COLUMNS)
