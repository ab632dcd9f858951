"""Access to the input tables (one parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


#: Session setting: number of partitions for CPU-heavy row work (regexes over whole texts,
#: JSON parsing); unset, the scan's own splits are kept and nothing is shuffled.
SPREAD_SETTING = "spark.tierlens.spreadPartitions"


def read(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Scan one table.  ``spread=True`` marks CPU-heavy per-row work, which an explicit
    session setting may deal out to more partitions (one unsplittable file on a laptop)."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = int(spark.conf.get(SPREAD_SETTING, "0") or 0) if spread else 0
    return df.repartition(parts) if parts > 0 else df
