"""A trained forest as a table: one row per node, scored by column expressions.

A node table holds plain rows (tree, node, feature, threshold, left, right, shares), so a
model can be read, joined, audited and scored by any SQL engine.  Scoring walks each tree
as a nested CASE over the features and adds up the leaves' class shares in tree order, as the
forest itself does, so both give the same numbers.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import scratch_path
from .selection import class_counts

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
#: Nodes of a table that may be scored (it is held in the plan); the fitted forest has at most 150 x 127.
MAX_NODES = 50_000


def node_table(model: PipelineModel) -> DataFrame:
    """The nodes of a fitted pipeline's forest: inner nodes go left where feature <= threshold;
    a leaf has feature -1 and its class shares (all zero where no training row weighed in)."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest-nodes")
    model.stages[-1].write().save(path)
    n = "nodeData"
    total = F.aggregate(f"{n}.impurityStats", F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(f"{n}.impurityStats", lambda x: F.when(total != 0, x / total).otherwise(F.lit(0.0)))
    leaf = F.col(f"{n}.leftChild") < 0
    inner = spark.read.parquet(f"{path}/data")
    categorical = F.col(f"{n}.split.numCategories") >= 0
    threshold = F.when(categorical, F.raise_error(F.lit("categorical splits have no threshold")).cast("double")).otherwise(
        F.try_element_at(f"{n}.split.leftCategoriesOrThreshold", F.lit(1)))
    return inner.select(F.col("treeID").alias("tree"), F.col(f"{n}.id").alias("node"), F.when(leaf, -1).otherwise(F.col(f"{n}.split.featureIndex")).alias("feature"),
                        F.when(~leaf, threshold).alias("threshold"), F.col(f"{n}.leftChild").alias("left"), F.col(f"{n}.rightChild").alias("right"),
                        F.when(leaf, shares).alias("shares"))


class Forest:
    """A node table fetched for scoring (its size is a parameter of the training, not of the data)."""

    def __init__(self, nodes: DataFrame):
        rows = nodes.limit(MAX_NODES + 1).collect()
        if len(rows) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes")
        self.trees: dict[int, dict[int, object]] = {}
        for r in rows:
            self.trees.setdefault(r.tree, {})[r.node] = r
        leaves = [r for r in rows if r.feature < 0]
        self.n_classes = max((len(r.shares) for r in leaves), default=0)

    def _case(self, tree: dict, at: int, features: list[str]) -> str:
        r = tree[at]
        if r.feature < 0:
            return "named_struct(" + ", ".join(f"'s{i}', {float(x)!r}D" for i, x in enumerate(r.shares)) + ")"
        return (f"CASE WHEN {features[r.feature]} <= {r.threshold!r}D THEN {self._case(tree, r.left, features)} "
                f"ELSE {self._case(tree, r.right, features)} END")

    def votes(self, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
        """``keep`` and the votes v0, v1, ... of each class, NULL where a feature is NULL."""
        known = F.lit(True)
        for c in features:
            known = known & F.col(c).isNotNull()
        inputs = df.select(*keep, known.alias("_known"), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
        names = [f"_f{i}" for i in range(len(features))]
        roots = {t: min(nodes) for t, nodes in self.trees.items()}
        leaves = inputs.select(*keep, "_known", *[F.expr(self._case(self.trees[t], roots[t], names)).alias(f"_t{t}") for t in sorted(roots)])

        def total(i: int) -> Column:
            out = F.lit(0.0)
            for t in sorted(roots):
                out = out + F.col(f"_t{t}").getField(f"s{i}")
            return F.when(F.col("_known"), out)
        return leaves.select(*keep, *[total(i).alias(f"v{i}") for i in range(self.n_classes)])


def score_nodes(df: DataFrame, nodes: DataFrame, keep: list[str], features: list[str] = C.FEATURE_COLUMNS) -> DataFrame:
    """D9 from a node table: ``keep``, predicted_tier (the first class with the most votes,
    counted from 1) and confidence (its share).  A NULL feature, no votes at all or an empty
    table give the default tier with the default confidence."""
    forest = Forest(nodes)
    votes = forest.votes(df, features, keep)
    v = [F.col(f"v{i}") for i in range(forest.n_classes)]
    if not v:
        return votes.select(*keep, F.lit(C.DEFAULT_TIER).alias("predicted_tier"), F.lit(C.DEFAULT_CONFIDENCE).alias("confidence"))
    whole = F.lit(0.0)
    for x in v:
        whole = whole + x
    best = F.greatest(*v) if len(v) > 1 else v[0]
    tier = F.lit(len(v))
    for i in reversed(range(len(v) - 1)):
        tier = F.when(v[i] == best, F.lit(i + 1)).otherwise(tier)
    ok = whole.isNotNull() & (whole > 0)
    return votes.select(*keep, F.when(ok, tier).otherwise(F.lit(C.DEFAULT_TIER)).cast("int").alias("predicted_tier"),
                        F.when(ok, best / F.when(whole > 0, whole)).otherwise(F.lit(C.DEFAULT_CONFIDENCE)).alias("confidence"))


def level_forest(train: DataFrame, label: str, depth: int = 3, features: list[str] = C.FEATURE_COLUMNS, counts: dict | None = None) -> DataFrame:
    """Node table of a forest of fixed shape, grown by two aggregates: a baseline that any SQL
    engine can grow again from the same rows.

    Tree t asks at level l for feature ``(t + l) mod n``, against the floor of its mean over
    the training rows plus one half; a leaf's shares are its rows per class, times the class
    weight, over their sum.  Labels are 1, 2, ...; no row, no nodes."""
    counts = class_counts(train, label) if counts is None else counts
    spark, n = train.sparkSession, len(features)
    classes, rows = range(1, max(counts, default=0) + 1), sum(counts.values())
    if not rows:
        return spark.createDataFrame([], NODE_SCHEMA)
    means = train.agg(*[F.floor(F.avg(c)).alias(c) for c in features]).first()
    cut = [float(means[c]) + 0.5 for c in features]

    def leaf(t: int) -> Column:
        at = F.lit(1)
        for level in range(depth):
            i = (t + level) % n
            at = at * 2 + F.when(F.col(features[i]) <= cut[i], 0).otherwise(1)
        return F.struct(F.lit(t).alias("tree"), at.alias("node"))
    spread = train.where(F.col(label).isNotNull()).select(label, F.explode(F.array(*[leaf(t) for t in range(n)])).alias("at"))
    per_leaf = spread.groupBy("at.tree", "at.node").agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes])
    k = sum(1 for c in counts.values() if c)
    seen = {}
    for r in per_leaf.collect():                                       # n trees of 2^depth leaves
        weighted = [r[f"n{c}"] * (rows / (k * counts[c])) if counts.get(c) else 0.0 for c in classes]
        whole = 0.0
        for x in weighted:
            whole += x
        seen[r.tree, r.node] = [x / whole for x in weighted]
    out = []
    for t in range(n):
        for node in range(1, 2 ** (depth + 1)):
            level = node.bit_length() - 1
            if level < depth:
                i = (t + level) % n
                out.append((t, node, i, cut[i], 2 * node, 2 * node + 1, None))
            else:
                out.append((t, node, -1, None, -1, -1, seen.get((t, node), [0.0] * len(classes))))
    return spark.createDataFrame(out, NODE_SCHEMA)
