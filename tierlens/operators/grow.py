"""D8's forest, grown from counted cells instead of rows.

Spark ML keeps the draws of every tree for each row and walks all trees for each row in every
pass.  A forest sees of a row only the bin of each feature and the label, so equal rows can be
counted first: the n rows of a cell together are drawn Poisson(n) times by a tree, which is
exactly what n draws of Poisson(1) add up to.  The work per tree then grows with the cells
(at most bins x label, whatever the number of rows), and each tree is grown by itself in one
task.  Everything else is Spark ML's method with the parameters of the given estimator: split
candidates at midpoints or weighted quantiles (over all rows, Spark ML samples them), a random
subset of the features at each node, the best weighted Gini gain, and leaves of one prediction
joined.  The draws depend on seed, tree and cells alone, not on how rows lie in partitions.

The model is written in Spark ML's own format and loaded from there.
"""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Spark ML's limit for labels that are inferred from the data.
MAX_LABELS = 100
#: Trees grown by one task, from one copy of the cells.
TREES_PER_TASK = 5
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
         "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")
EPSILON = np.finfo(float).eps


# --------------------------------------------------------------------------- split candidates
def split_candidates(value: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Thresholds for distinct sorted values and the weight of each: all midpoints,
    or about ``most`` of them that cut the weight into equal strides."""
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= most:
        return middle
    stride = weight.sum() / (most + 1)
    out, target, before = [], stride, 0.0
    for i, now in enumerate(np.cumsum(weight)):
        if i and abs(before - target) < abs(now - target):
            out.append(middle[i - 1])
            target += stride
        before = now
    return np.array(out)


def _candidates(rows: DataFrame, features: list[str], most: int) -> list[np.ndarray]:
    """Thresholds per feature; one task gathers the distinct values of a feature."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(features)])).alias("at")
    values = rows.select(each, "weight", "n").groupBy("at.feature", "at.value", "weight").agg(F.sum("n").alias("n"))

    def cut(table: pa.Table) -> pa.Table:
        value, place = np.unique(table["value"].to_numpy(), return_inverse=True)
        order = np.lexsort((table["weight"].to_numpy(), place))
        weight = np.bincount(place[order], weights=(table["weight"].to_numpy() * table["n"].to_numpy())[order], minlength=len(value))
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()),
                         "thresholds": pa.array([split_candidates(value, weight, most).tolist()], pa.list_(pa.float64()))})
    found = {r.feature: np.array(r.thresholds) for r in values.groupBy("feature").applyInArrow(cut, "feature int, thresholds array<double>").collect()}
    return [found[i] for i in range(len(features))]


# --------------------------------------------------------------------------- cells
def _cells(rows: DataFrame, features: list[str], thresholds: list[np.ndarray]) -> DataFrame:
    """Rows per (bin of each feature, label): bins b0, b1, ..., label, n."""
    names = [f"b{i}" for i in range(len(features))]

    def to_bins(batches):
        for b in batches:
            bins = [pa.array(np.searchsorted(t, b.column(i).to_numpy(zero_copy_only=False)), pa.int32()) for i, t in enumerate(thresholds)]
            yield pa.RecordBatch.from_arrays([*bins, b.column(len(bins)), b.column(len(bins) + 1)], names=[*names, "label", "n"])
    binned = rows.select(*features, F.col("label").cast("int").alias("label"), "n").mapInArrow(to_bins, ", ".join(f"{x} int" for x in names) + ", label int, n long")
    return binned.groupBy(*names, "label").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- one tree
class _Node:
    def __init__(self, drawn: np.ndarray, weights: np.ndarray):
        self.drawn, self.stats = drawn, drawn * weights
        self.impurity = float(_gini(self.stats))
        self.prediction = int(np.argmax(self.stats))
        self.gain, self.feature, self.threshold = -1.0, -1, None
        self.left: _Node | None = None
        self.right: _Node | None = None


def _gini(stats: np.ndarray) -> np.ndarray:
    whole = stats.sum(axis=-1, keepdims=True)
    share = np.divide(stats, whole, out=np.zeros_like(stats), where=whole > 0)
    return np.where(whole[..., 0] > 0, 1 - (share * share).sum(axis=-1), 0.0)


def grow_tree(bins: list[np.ndarray], label: np.ndarray, drawn: np.ndarray, weights: np.ndarray, thresholds: list[np.ndarray],
              per_node: int, depth: int, least: int, least_gain: float, rng: np.random.Generator) -> _Node:
    """A tree over cells that were drawn ``drawn`` times, level by level."""
    k = len(weights)
    kept = np.flatnonzero(drawn)
    at, drawn = np.zeros(len(kept), np.int64), drawn[kept].astype(float)
    root = _Node(np.bincount(label[kept], drawn, k), weights)
    active = [root]
    for level in range(depth):
        m = len(active)
        if not m:
            break
        wanted = np.zeros((m, len(bins)), bool)
        for j in range(m):
            wanted[j, rng.choice(len(bins), per_node, replace=False)] = True
        impurity = np.array([x.impurity for x in active])
        best = [(-math.inf, -1, -1, None)] * m
        for f, cuts in enumerate(thresholds):
            mine = np.flatnonzero(wanted[:, f])
            if not len(cuts) or not len(mine):
                continue
            size = len(cuts) + 1
            counts = np.bincount((at * size + bins[f][kept]) * k + label[kept], drawn, m * size * k).reshape(m, size, k)[mine]
            below = counts.cumsum(axis=1)
            left, right = below[:, :-1], below[:, -1:] - below[:, :-1]
            a, b = (left * weights), (right * weights)
            share = a.sum(axis=2) / np.maximum(a.sum(axis=2) + b.sum(axis=2), np.finfo(float).tiny)
            gain = impurity[mine, None] - share * _gini(a) - (1 - share) * _gini(b)
            gain[(left.sum(axis=2) < least) | (right.sum(axis=2) < least) | (gain < least_gain)] = -math.inf
            for j, i in zip(mine, gain.argmax(axis=1)):
                g = gain[np.searchsorted(mine, j), i]
                if g > best[j][0]:
                    row = np.searchsorted(mine, j)
                    best[j] = (g, f, i, (left[row, i], right[row, i]))
        following: list[_Node] = []
        side = np.full((m, 2), -1)                                 # place of a child among the next level's nodes
        for j, (gain, f, i, parts) in enumerate(best):
            if gain <= 0:
                continue
            node = active[j]
            node.gain, node.feature, node.threshold = float(gain), f, float(thresholds[f][i])
            node.left, node.right = (_Node(x, weights) for x in parts)
            for s, child in enumerate((node.left, node.right)):
                if level + 1 < depth and child.impurity >= EPSILON:
                    side[j, s] = len(following)
                    following.append(child)
        place = np.full(len(kept), -1)
        for f in range(len(bins)):
            cut = np.array([i if g > 0 and x == f else -1 for g, x, i, _ in best])
            here = cut[at] >= 0
            place[here] = side[at[here], (bins[f][kept[here]] > cut[at[here]]).astype(int)]
        go = place >= 0
        kept, drawn, at, active = kept[go], drawn[go], place[go], following
    return root


def _pruned(node: _Node) -> _Node:
    """Two leaves of one prediction become their parent."""
    if node.left is not None:
        _pruned(node.left), _pruned(node.right)
        if node.left.left is None and node.right.left is None and node.left.prediction == node.right.prediction:
            node.left = node.right = None
    return node


def _as_rows(root: _Node) -> list[dict]:
    """Nodes in preorder, as Spark ML numbers them."""
    out: list[dict] = []

    def add(n: _Node) -> int:
        leaf = n.left is None
        row = {"id": len(out), "prediction": float(n.prediction), "impurity": n.impurity, "impurityStats": n.stats.tolist(), "rawCount": int(n.drawn.sum()),
               "gain": -1.0 if leaf else n.gain, "leftChild": -1, "rightChild": -1,
               "split": {"featureIndex": -1 if leaf else n.feature, "leftCategoriesOrThreshold": [] if leaf else [n.threshold], "numCategories": -1}}
        out.append(row)
        if not leaf:
            row["leftChild"], row["rightChild"] = add(n.left), add(n.right)
        return row["id"]
    add(root)
    return out


# --------------------------------------------------------------------------- the forest
def _per_node(strategy: str, features: int) -> int:
    if strategy in ("auto", "sqrt"):
        return math.ceil(math.sqrt(features))
    if strategy == "all":
        return features
    raise ValueError(f"feature subsets {strategy!r} are not known here")


def fit_counted(rows: DataFrame, rf: RandomForestClassifier, features: list[str]) -> RandomForestClassificationModel:
    """Fit ``rf`` on ``rows``: ``features``, the estimator's label and weight columns (one weight
    per label) and ``n``, the number of equal rows that a row stands for.  As in Spark ML, features
    must be finite numbers."""
    spark = rows.sparkSession
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(rf.getLabelCol()).cast("double").alias("label"),
                       F.col(rf.getWeightCol()).alias("weight"), "n")
    finite = F.lit(True)
    for c in features:
        finite = finite & (F.abs(c) < F.lit(math.inf))             # false for NaN, which is beyond all numbers
    classes = rows.groupBy("label", "weight").agg(F.sum("n").alias("n"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad")).limit(MAX_LABELS + 1).collect()
    if not classes:
        raise ValueError("no row to fit on")
    if any(r.bad for r in classes):
        raise ValueError("features must not be NULL, NaN or infinite")
    if len(classes) > MAX_LABELS or len({r.label for r in classes}) < len(classes):
        raise ValueError(f"more than {MAX_LABELS} classes, or more than one weight for a label")
    if any(r.label is None or r.weight is None or r.label < 0 or r.label >= MAX_LABELS or r.label != int(r.label) for r in classes):
        raise ValueError(f"labels must be 0 to {MAX_LABELS - 1} and have a weight")
    k, trees, depth, seed = 1 + int(max(r.label for r in classes)), rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()
    weights = np.zeros(k)
    for r in classes:
        weights[int(r.label)] = r.weight
    per_node, least, least_gain = _per_node(rf.getFeatureSubsetStrategy(), len(features)), rf.getMinInstancesPerNode(), rf.getMinInfoGain()
    rate = rf.getSubsamplingRate() if rf.getBootstrap() else 0
    if not rate and rf.getSubsamplingRate() != 1:
        raise ValueError("subsampling without replacement is not known here")
    thresholds = _candidates(rows, features, min(rf.getMaxBins(), sum(r.n for r in classes)) - 1)
    blocks = -(-trees // TREES_PER_TASK)
    copies = _cells(rows, features, thresholds).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(blocks, "block")

    def grow(table: pa.Table) -> pa.Table:
        column = {c: table[c].to_numpy() for c in table.column_names}
        order = np.lexsort([column["label"], *[column[f"b{i}"] for i in reversed(range(len(thresholds)))]])
        bins, label, n = [column[f"b{i}"][order].astype(np.int64) for i in range(len(thresholds))], column["label"][order].astype(np.int64), column["n"][order]
        block, out = int(column["block"][0]), []
        for tree in range(block * TREES_PER_TASK, min(trees, (block + 1) * TREES_PER_TASK)):
            rng = np.random.default_rng([seed, tree])
            root = grow_tree(bins, label, rng.poisson(n * rate) if rate else n, weights, thresholds, per_node, depth, least, least_gain, rng)
            out += [{"treeID": tree, "nodeData": r} for r in _as_rows(_pruned(root))]
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_json_string
        return pa.Table.from_pylist(out, schema=to_arrow_schema(_parse_datatype_json_string(of_nodes)))
    of_nodes = spark.createDataFrame([], NODES).schema.json()
    path = scratch_path(spark, "forest")
    copies.groupBy("block").applyInArrow(grow, NODES).write.parquet(f"{path}/data")
    _describe(spark, path, rf, len(features), k)
    return RandomForestClassificationModel.load(path)


def _describe(spark, path: str, rf: RandomForestClassifier, features: int, classes: int) -> None:
    """The metadata beside the nodes, as Spark ML writes them."""
    def params(of: dict, names) -> dict:
        return {p.name: v for p, v in of.items() if names is None or p.name in names}

    def record(kind: str, uid: str, names, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": params(rf._paramMap, names), "defaultParamMap": params(rf._defaultParamMap, names), **more})
    of_tree = {"featuresCol", "labelCol", "weightCol", "maxBins", "maxDepth", "seed", "impurity", "minInfoGain", "minInstancesPerNode"}
    whole = record("RandomForestClassificationModel", rf.uid, None, numFeatures=features, numClasses=classes, numTrees=rf.getNumTrees())
    trees = [(t, record("DecisionTreeClassificationModel", f"{rf.uid}_{t}", of_tree), 1.0) for t in range(rf.getNumTrees())]
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
