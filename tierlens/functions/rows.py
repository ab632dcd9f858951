"""Row selection on computed flags, and aggregates gathered while a job runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def keep_rows(df: DataFrame, flag: Column) -> DataFrame:
    """Rows of ``df`` where ``flag`` is true (NULL counts as false).

    For flags computed from expensive columns (parsed JSON, verdicts):
    ``df.where(flag)`` would be pushed below the projections that compute the
    flag's inputs, down to the scan, and evaluate them a second time there.  A
    generator that repeats each row once or not at all is not pushed down, so the
    inputs are computed once, where they are staged.
    """
    times = F.when(flag, F.lit(1)).otherwise(F.lit(0))
    return df.select("*", F.explode(F.array_repeat(F.lit(True), times)).alias("_keep")).drop("_keep")


def observed(df: DataFrame, metrics: dict[str, Column], action: Callable[[DataFrame], Any]) -> dict[str, Any]:
    """Run ``action`` on ``df`` and return aggregates of ``df`` gathered in the same pass.

    Where the optimizer has replaced a plan by an empty one, its observation is gone with it;
    the aggregates are then computed by themselves.  A re-run task may count twice: a
    caller that needs exact numbers checks them."""
    seen = Observation()
    action(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    try:
        return seen.get
    except Py4JJavaError:
        return df.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()
