"""W2 as a base and deltas: the current request log without joining all verdicts ever made.

The log and the verdicts only grow.  :func:`compact` folds what is new into a base, the log
with the latest verdicts filled in, kept as one folder per day and version; only days that
new rows or verdicts touch are written again.  A manifest says which folder is a day's
base and which appends and verdict batches it contains.  Manifests are numbered files that
are published once (:mod:`..sources.shared_files`), after everything they name is written:
a reader sees the state before or after a compaction, and a writer that dies in between
leaves only unused folders.  Of two compactions at once one gives way.

:func:`read_current` reads the base and, as long as there are any, the appends and verdicts
that came after it; its cost does not depend on how many batches there ever were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import LOG_TABLE_SCHEMA
from ..sources.shared_files import Sequence, exists, names
from .jobs import VERDICT_SCHEMA, current_log

EMPTY = {"days": {}, "appends": [], "verdicts": []}


def _ranges(numbers: set[int]) -> list[list[int]]:
    """Sorted numbers as [first, last] ranges."""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


def _in(n: int, ranges: list[list[int]]) -> bool:
    return any(a <= n <= b for a, b in ranges)


def _numbers(ranges: list[list[int]]) -> set[int]:
    return {n for a, b in ranges for n in range(a, b + 1)}


def _manifests(spark: SparkSession, log: str) -> Sequence:
    return Sequence(spark, log.rstrip("/") + "_current", "manifest")


def _folders(spark: SparkSession, path: str, key: str) -> list[int]:
    return [int(n[len(key) + 1:]) for n in names(spark, path) if n.startswith(f"{key}=")]


def _state(spark: SparkSession, log: str, verdicts: str) -> tuple[int, dict, list[int], list[int]]:
    """(number of the manifest, manifest, finished appends it lacks, verdict batches it lacks).
    Verdicts are listed first: the log rows they are about are there by then."""
    sequence = _manifests(spark, log)
    n = sequence.last()
    m = EMPTY if n < 0 else sequence.read(n)
    batches = [b for b in _folders(spark, verdicts, "batch_id") if not _in(b, m["verdicts"])]
    appends = [a for a in _folders(spark, log, "append") if not _in(a, m["appends"]) and exists(spark, f"{log.rstrip('/')}/append={a}/_SUCCESS")]
    return n, m, sorted(appends), sorted(batches)


def read_folders(spark: SparkSession, schema, root: str, folders: list[str]) -> DataFrame:
    """Partition folders of a table, as its columns; none is an empty table."""
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{f}" for f in folders])
    return df.select(*spark.createDataFrame([], schema).columns)


def base_days(spark: SparkSession, log: str) -> dict[str, str]:
    """The version of each day's base."""
    sequence = _manifests(spark, log)
    n = sequence.last()
    return EMPTY["days"] if n < 0 else sequence.read(n)["days"]


def base_rows(spark: SparkSession, log: str, days: dict) -> DataFrame:
    """Rows of the base of these days (day: version)."""
    root = log.rstrip("/") + "_current/base"
    return read_folders(spark, LOG_TABLE_SCHEMA, root, [f"v={v}/day={d}" for d, v in sorted(days.items())])


def _filled(spark: SparkSession, log: str, verdicts: str, days: dict, appends: list[int], batches: list[int]) -> DataFrame:
    rows = base_rows(spark, log, days).unionByName(read_folders(spark, LOG_TABLE_SCHEMA, log.rstrip("/"), [f"append={a}" for a in appends]))
    if not batches:
        return rows
    new = read_folders(spark, VERDICT_SCHEMA, verdicts.rstrip("/"), [f"batch_id={b}" for b in batches])
    return current_log(rows, new, "batch_id")


def read_current(spark: SparkSession, log: str, verdicts: str) -> DataFrame:
    """The log with the latest verdict of each id filled in (S3 columns)."""
    _, m, appends, batches = _state(spark, log, verdicts)
    return _filled(spark, log, verdicts, m["days"], appends, batches)


def compact(spark: SparkSession, log: str, verdicts: str) -> bool:
    """Fold new appends and verdicts into the base.  False if there was nothing to do or
    another compaction was faster."""
    n, m, appends, batches = _state(spark, log, verdicts)
    if not appends and not batches:
        return False
    new_rows = read_folders(spark, LOG_TABLE_SCHEMA, log.rstrip("/"), [f"append={a}" for a in appends])
    new = read_folders(spark, VERDICT_SCHEMA, verdicts.rstrip("/"), [f"batch_id={b}" for b in batches])
    # days are as few as a calendar's; a verdict without its day may be about any of them
    touched = {str(r[0]) if r[0] else None for r in new_rows.select("day").unionByName(new.select("day")).distinct().collect()}
    known = set(m["days"]) if None in touched else touched & set(m["days"])
    version = uuid.uuid4().hex[:12]
    out = _filled(spark, log, verdicts, {d: m["days"][d] for d in known}, appends, batches)
    path = f"{log.rstrip('/')}_current/base/v={version}"
    out.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    days = m["days"] | {d[4:]: version for d in names(spark, path) if d.startswith("day=")}
    return _manifests(spark, log).offer(n + 1, {"days": days, "appends": _ranges(_numbers(m["appends"]) | set(appends)),
                                                "verdicts": _ranges(_numbers(m["verdicts"]) | set(batches))})


def vacuum_candidates(spark: SparkSession, log: str) -> DataFrame:
    """Base folders that the newest manifest does not name (old versions, lost compactions):
    they may be removed once no reader of an older manifest is left."""
    sequence = _manifests(spark, log)
    n = sequence.last()
    used = set((EMPTY if n < 0 else sequence.read(n))["days"].items())
    root = log.rstrip("/") + "_current/base"
    found = [(v, d[4:]) for v in names(spark, root) if v.startswith("v=") for d in names(spark, f"{root}/{v}") if d.startswith("day=")]
    return spark.createDataFrame([(v[2:], d) for v, d in found if (d, v[2:]) not in used], "version string, day string")
