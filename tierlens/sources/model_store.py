"""Versions of the routing classifier, with feature list and version tag.

A saved version is a folder that is never changed: the fitted pipeline (if there is one), its
node table and a one-row metadata table.  Which version is current is a numbered pointer
record (:mod:`.shared_files`) that names such a folder, published after everything in the
folder is written: a reader sees the old version or the new one, whole, and a writer that
dies half-way changes nothing.  Pointers are never removed, so the history stays and
:func:`rollback` is one more pointer.

``load_model`` and ``load_nodes`` treat only "no version was ever promoted" as the absence of
a model; a pointer to an unreadable folder, missing rights and the like are errors.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ACCURACY_GATE, FEATURE_COLUMNS
from ..operators.forest import node_table
from .shared_files import Sequence

HISTORY_SCHEMA = "seq long, folder string, version_tag string, accuracy double, action string"


def _pointers(spark: SparkSession, path: str) -> Sequence:
    return Sequence(spark, f"{path.rstrip('/')}/current", "pointer")


def write_version(path: str, version: str, model: PipelineModel | None = None, nodes: DataFrame | None = None) -> str:
    """Write a version that is not current yet; returns its folder's name."""
    folder = f"{version}-{uuid.uuid4().hex[:12]}"
    at = f"{path.rstrip('/')}/versions/{folder}"
    spark = SparkSession.getActiveSession()
    if model is not None:
        model.write().save(f"{at}/model")
    nodes = node_table(model) if nodes is None else nodes
    nodes.write.parquet(f"{at}/nodes")
    meta = spark.range(1).select(F.lit(version).alias("version_tag"), F.array(*[F.lit(c) for c in FEATURE_COLUMNS]).alias("input_features"),
                                 F.current_timestamp().alias("saved_at"))
    meta.write.parquet(f"{at}/metadata")
    return folder


def _point(spark: SparkSession, path: str, record: dict) -> None:
    pointers = _pointers(spark, path)
    while not pointers.offer(pointers.last() + 1, record):
        pass


def promote(spark: SparkSession, path: str, folder: str, accuracy: float | None = None, gate: float | None = ACCURACY_GATE) -> bool:
    """Make a written version current if its accuracy passes the gate (D10); without a gate
    always.  False: the version stays unused and the current one stays current."""
    if gate is not None and (accuracy is None or not accuracy >= gate):
        return False
    version = spark.read.parquet(f"{path.rstrip('/')}/versions/{folder}/metadata").first().version_tag
    _point(spark, path, {"folder": folder, "version_tag": version, "accuracy": accuracy, "action": "promote"})
    return True


def _records(spark: SparkSession, path: str) -> list[dict]:
    pointers = _pointers(spark, path)
    return [pointers.read(n) for n in range(pointers.last() + 1)]


def rollback(spark: SparkSession, path: str) -> bool:
    """Make the version current that was promoted before the current one; False if none was."""
    stack: list[dict] = []
    for r in _records(spark, path):
        if r["action"] == "promote":
            stack.append(r)
        else:
            stack.pop()
    if len(stack) < 2:
        return False
    _point(spark, path, stack[-2] | {"action": "rollback"})
    return True


def history(spark: SparkSession, path: str) -> DataFrame:
    """Every pointer in order; the last one is current."""
    rows = [(i, r["folder"], r["version_tag"], r["accuracy"], r["action"]) for i, r in enumerate(_records(spark, path))]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def _current(spark: SparkSession, path: str) -> str | None:
    pointers = _pointers(spark, path)
    n = pointers.last()
    return None if n < 0 else f"{path.rstrip('/')}/versions/{pointers.read(n)['folder']}"


def save_model(model: PipelineModel, path: str, version: str) -> None:
    """Write a version and make it current, without a gate."""
    spark = SparkSession.getActiveSession()
    promote(spark, path, write_version(path, version, model), gate=None)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | None, DataFrame | None]:
    """The current pipeline and its metadata; no version -> (None, None): callers fall back to
    the default route (D9)."""
    at = _current(spark, path)
    if at is None:
        return None, None
    return PipelineModel.load(f"{at}/model"), spark.read.parquet(f"{at}/metadata")


def load_nodes(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The current version's node table and its metadata, or (None, None)."""
    at = _current(spark, path)
    if at is None:
        return None, None
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/metadata")
