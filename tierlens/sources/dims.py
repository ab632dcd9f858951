"""Dimensions: model registry (S5), routing policy (S6), model-id aliases.

These are configuration-sized (five models, three tiers): read on the driver,
validated, and turned into tiny DataFrames that joins broadcast.  Their size is
bounded by the configuration file, not by the data.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import constants as C

DEFAULT_POLICY = os.path.join(os.path.dirname(__file__), "routing_policy.yaml")

REGISTRY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model_id", T.StringType(), False),
    T.StructField("cost_per_input_token", T.DoubleType(), False),
    T.StructField("cost_per_output_token", T.DoubleType(), False),
    T.StructField("avg_latency_seconds", T.DoubleType(), False),
    T.StructField("quality_tier", T.StringType(), False),
])

POLICY_SCHEMA = T.StructType([
    T.StructField("tier", T.IntegerType(), False),
    T.StructField("tier_name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("policy_provider", T.StringType(), False),
    T.StructField("policy_model_id", T.StringType(), False),
    T.StructField("fallback_model_id", T.StringType(), False),
    T.StructField("max_tokens", T.IntegerType(), False),
    T.StructField("temperature", T.DoubleType(), False),
])


def model_registry(spark: SparkSession, rows=None) -> DataFrame:
    """The price/latency dimension; quality_tier must be high, medium or low."""
    rows = list(rows if rows is not None else C.REGISTRY)
    for r in rows:
        if r[6] not in C.QUALITY_TIERS:
            raise ValueError(f"quality_tier must be one of {C.QUALITY_TIERS}: {r}")
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def registry_entry(key: str) -> tuple:
    """Strict configuration lookup of one registry row (unknown key -> KeyError)."""
    for row in C.REGISTRY:
        if row[0] == key:
            return row
    raise KeyError(f"Model keys must be listed in the registry: {key} not found")


def model_aliases(spark: SparkSession) -> DataFrame:
    """Policy model id -> registry key; registry keys map to themselves."""
    rows = [(k, k) for k, *_ in C.REGISTRY] + list(C.MODEL_ALIASES)
    return spark.createDataFrame(rows, "model_ref string, registry_key string")


@dataclass(frozen=True)
class Policy:
    version: str
    last_modified: str
    routes: dict            # tier -> dict of the POLICY_SCHEMA fields
    retry_attempts: int
    timeout_seconds: float
    fallback_on_http_codes: tuple

    @property
    def tiers(self) -> list[int]:
        return sorted(self.routes)


_ROUTE_FIELDS = {"tier_name": str, "description": str, "provider": str, "model_id": str,
                 "fallback_model_id": str, "max_tokens": int, "temperature": float}


def _typed(value, typ, where):
    if typ is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if typ is int and isinstance(value, str) and value.strip().lstrip("+-").isdigit():
        return int(value)
    if typ is float and isinstance(value, str):
        try:
            return float(value)
        except ValueError:
            pass
    if not isinstance(value, typ) or isinstance(value, bool) and typ is not bool:
        raise ValueError(f"Structural validation error in routing policy: {where} must be {typ.__name__}")
    return value


def load_policy(path: str = DEFAULT_POLICY) -> Policy:
    """Parse and type-check the policy file; a missing file or field is an error."""
    import yaml
    if not os.path.exists(path):
        raise FileNotFoundError(f"policy file missing at {path}")
    with open(path) as fh:
        raw = yaml.safe_load(fh)
    try:
        routes = {}
        for tier, spec in raw["routing_map"].items():
            t = _typed(tier, int, "routing_map key")
            routes[t] = {f: _typed(spec[f], typ, f"routing_map.{tier}.{f}") for f, typ in _ROUTE_FIELDS.items()}
        rt = raw["runtime_policies"]
        return Policy(version=_typed(raw["version"], str, "version"),
                      last_modified=_typed(raw["last_modified"], str, "last_modified"),
                      routes=routes,
                      retry_attempts=_typed(rt["retry_attempts"], int, "retry_attempts"),
                      timeout_seconds=_typed(rt["timeout_seconds"], float, "timeout_seconds"),
                      fallback_on_http_codes=tuple(_typed(c, int, "fallback_on_http_codes")
                                                   for c in rt["fallback_on_http_codes"]))
    except KeyError as e:
        raise ValueError(f"Structural validation error in routing policy: missing {e}") from e


def policy_frame(spark: SparkSession, policy: Policy) -> DataFrame:
    """S6 as a DataFrame: one row per tier."""
    rows = [(t, r["tier_name"], r["description"], r["provider"], r["model_id"], r["fallback_model_id"],
             r["max_tokens"], r["temperature"]) for t, r in sorted(policy.routes.items())]
    return spark.createDataFrame(rows, POLICY_SCHEMA)
