"""Money aggregation: exact decimal sums so results do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,10)"


def money(c: Column | str) -> Column:
    """Decimal value; NaN, infinity and values beyond the type give NULL instead of an error
    (the log table rejects such costs when they are written)."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(MONEY)


def money_sum(c: Column | str) -> Column:
    """Sum as DECIMAL(20,10), back to double; empty input sums to 0."""
    return F.coalesce(F.sum(money(c)), F.lit(0).cast(MONEY)).cast("double")
