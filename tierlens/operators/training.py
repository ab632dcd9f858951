"""Split, weighting, forest training, scoring and evaluation.

Everything is distributed: the exact stratified split finds the last test row of each
label by counting, and class weights are literals, so a label holding a third of all
rows is never sorted or gathered in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import observed
from ..session import scratch_path, stored
from . import grow, selection
from .features import online_routing_features

FEATURES = C.FEATURE_COLUMNS


# --------------------------------------------------------------------------- D6
def split_hash(key_cols: list[str], seed: int = C.FOREST_SEED) -> Column:
    """Row order inside a label: SHA-256 of ``seed:key``, ties broken by the key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]), 256)


def _target(n: Column, fraction: float) -> Column:
    """round-half-up(n * fraction) in exact integer arithmetic."""
    fr = Fraction(fraction).limit_denominator(10_000)
    return F.call_function("div", n * (2 * fr.numerator) + fr.denominator, F.lit(2 * fr.denominator)).cast("long")


SPLIT_BUCKET_BITS = 20


def stratified_split(df: DataFrame, label: str, key_cols: list[str],
                     test_fraction: float = C.TEST_FRACTION, seed: int = C.FOREST_SEED,
                     bucket_bits: int = SPLIT_BUCKET_BITS) -> DataFrame:
    """Adds ``is_test``: exactly round(fraction * n_label) rows per label are test,
    namely the first ones in (hash, key) order.  Repeatable for a given seed.

    The last test row of each label is found by counting (:mod:`.selection`, in passes over
    the keys alone); the result then reads the rows once and compares.  Rows without a
    label are never test rows.
    """
    if not 1 <= bucket_bits <= 28:
        raise ValueError("bucket_bits must be in 1..28")
    h = split_hash(key_cols, seed)
    found = selection.thresholds(df, label, key_cols, h, lambda n: _target(n, test_fraction), bucket_bits)
    return selection.chosen(df, label, key_cols, h, found, "is_test")


# --------------------------------------------------------------------------- D7
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_label) per label (one row per label), in one pass."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    n, k = F.col("n"), F.size("per_label")
    whole = counts.agg(F.sum("n_label").alias("n"), F.collect_list(F.struct(label, "n_label")).alias("per_label"))   # one row per class
    some = F.when(k > selection.MAX_CLASSES, F.raise_error(F.lit("too many classes")).cast(whole.schema["per_label"].dataType)).otherwise(F.col("per_label"))
    return (whole.select("n", k.alias("k"), F.inline(some))
            .select(label, "n_label", (n.cast("double") / (F.col("k") * F.col("n_label")).cast("double")).alias("weight")))


def weight_column(label: str, counts: dict) -> Column:
    """D7 as an expression: the weight of a row's label from counted classes."""
    selection.check_classes(len(counts))
    n, k = sum(counts.values()), sum(1 for c in counts.values() if c)
    out = F.lit(None).cast("double")
    for x, c in counts.items():
        if c:
            out = F.when(F.col(label) == F.lit(x), F.lit(n / (k * c))).otherwise(out)
    return out


def with_class_weight(df: DataFrame, label: str, counts: dict | None = None) -> DataFrame:
    """Rows with a label and their ``weight``.  No join and no shuffle of the rows: the weights
    are literals; without given ``counts`` one aggregate counts the classes first."""
    counts = selection.class_counts(df, label) if counts is None else counts
    return df.where(F.col(label).isNotNull()).withColumn("weight", weight_column(label, counts))


#: Rows of a training matrix for one task of the fit, at most: about 200 MB of Spark ML's copy
#: (150 draws a row), and enough work to outweigh the sums of all nodes that each task sends.
FIT_ROWS = 1 << 18
#: Documents for one task that featurises them with all their templates, at most.
FEATURE_ROWS = 1 << 12


def dealt(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in equal parts of at most ``per_task`` rows; where that is fewer parts than cores, in
    one per core, but of no less than a quarter of that.  What makes one part is left as it is.

    The parts of a scan follow from bytes.  A matrix takes a few bytes a row, so a scan would
    give all the work of the fit to a few tasks; so would one row group of documents."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-rows // per_task), min(cores, 4 * rows // per_task))
    return df.repartition(parts) if parts > 1 else df


def written_matrix(df: DataFrame, label: str, name: str, train: Column | None = None, labels: list = C.CLASS_LABELS) -> tuple[DataFrame, dict]:
    """Write a training matrix below the shared folder, counting its classes in the same pass
    (only rows where ``train`` holds); returns the written table and the counts.

    The fit reads its matrix many times: it comes from the table, which a lost executor
    does not touch, and whose number of rows must agree with what was counted.  Its rows are
    dealt out evenly, so the tasks of the fit and of the scoring grow in number, not in size."""
    of_train = F.lit(True) if train is None else train
    metrics = {"rows": F.count(F.lit(1)), "labelled": F.count_if(of_train & F.col(label).isNotNull())}
    metrics |= {f"n{i}": F.count_if(of_train & (F.col(label) == x)) for i, x in enumerate(labels)}
    path = scratch_path(df.sparkSession, name)
    got = observed(df, metrics, lambda rows: rows.write.parquet(path))
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    counts = {x: got[f"n{i}"] for i, x in enumerate(labels)}
    rows = table.count()
    if got["rows"] != rows or got["labelled"] != sum(counts.values()):     # a re-run task, or labels beyond the list
        counts = selection.class_counts(table.where(of_train), label)
    return dealt(table, rows, FIT_ROWS), counts


#: Column of a tallied table: how many equal rows a row stands for.
TIMES = "times"


def written_tally(df: DataFrame, label: str, name: str, train: Column | None = None) -> tuple[DataFrame, dict]:
    """Like :func:`written_matrix`, with equal rows written once and their number in ``times``:
    the features are small integers, so the table, the fit on it and the scoring of it do not
    grow in proportion to the rows.  A row that no other equals is one row with ``times`` 1."""
    table = stored(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(TIMES)), name)
    of_train = F.lit(True) if train is None else train
    found = table.where(of_train & F.col(label).isNotNull()).groupBy(label).agg(F.sum(TIMES).alias("n")).limit(selection.MAX_CLASSES + 1).collect()
    selection.check_classes(len(found))
    return dealt(table, table.count(), FIT_ROWS), {r[0]: r.n for r in found}


# --------------------------------------------------------------------------- D8 / S7
def forest_pipeline(label_col: str = "label_idx", weight_col: str = "weight") -> Pipeline:
    """150 trees, depth 6, seed 42, class-weighted, on the five F12 inputs."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label_col, weightCol=weight_col,
                                numTrees=C.FOREST_TREES, maxDepth=C.FOREST_DEPTH, seed=C.FOREST_SEED,
                                maxBins=256)
    return Pipeline(stages=[assembler, rf])


def weighted_matrix(train: DataFrame, label: str, counts: dict | None = None, times: str | None = None) -> DataFrame:
    """What the forest is fitted on: the five features, the label from 0 on, the weight (and
    ``times``, where rows stand for several)."""
    return with_class_weight(train, label, counts).select(*FEATURES, (F.col(label) - 1).cast("double").alias("label_idx"), "weight", *([times] if times else []))


def train_forest(train: DataFrame, label: str, counts: dict | None = None, times: str | None = None) -> PipelineModel:
    """Fit on rows with a ``label`` in 1..3 and the five features; with ``times`` a row stands
    for that many equal ones (``counts`` are then needed, and of all of them).

    Equal rows are counted and drawn together (:mod:`.grow`), so the fit does not walk the rows."""
    if times and counts is None:
        raise ValueError("counts are needed for rows that stand for several")
    rows = weighted_matrix(train, label, counts, times)
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    assembler, rf = forest_pipeline().getStages()
    counted = rows.groupBy(*FEATURES, "label_idx", "weight").agg(n.alias("n"))
    return PipelineModel([assembler, grow.fit_counted(counted, rf, FEATURES)])


# --------------------------------------------------------------------------- D9
def score(df: DataFrame, model: PipelineModel | None, keep: list[str]) -> DataFrame:
    """Predicted tier and confidence (highest class probability).

    No model -> tier 1 with confidence 1.0 for every row.  Rows the model cannot
    score (a NULL feature) fall back the same way.
    """
    if model is None:
        return df.select(*keep, F.lit(C.DEFAULT_TIER).alias("predicted_tier"),
                         F.lit(C.DEFAULT_CONFIDENCE).alias("confidence"))
    out = model.transform(df)
    ok = F.col("prediction").isNotNull()
    for c in FEATURES:
        ok = ok & F.col(c).isNotNull()
    return out.select(
        *keep,
        F.when(ok, (F.col("prediction") + 1).cast("int")).otherwise(F.lit(C.DEFAULT_TIER)).alias("predicted_tier"),
        F.when(ok, F.array_max(vector_to_array("probability"))).otherwise(F.lit(C.DEFAULT_CONFIDENCE))
         .alias("confidence"))


def score_prompts(prompts: DataFrame, model: PipelineModel | None, key: str) -> DataFrame:
    """D9 on raw prompts: F12 with the online defaults, then :func:`score`."""
    feats = online_routing_features(prompts, keep=[key])
    return score(feats, model, [key])


# --------------------------------------------------------------------------- D10-D13
def _rows_where(condition: Column, times: str | None) -> Column:
    """Number of rows where ``condition`` holds; with ``times`` a row counts that often."""
    return F.count_if(condition) if times is None else F.coalesce(F.sum(F.when(condition, F.col(times))), F.lit(0))


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction",
             gate: float = C.ACCURACY_GATE, times: str | None = None) -> DataFrame:
    """Accuracy and the pass flag of the gate; with ``times`` a row counts that often (D11-D13 too)."""
    hit = F.col(label) == F.col(pred)
    if times is None:
        acc = F.avg(hit.cast("int"))
    else:
        acc = F.sum(hit.cast("long") * F.col(times)).cast("double") / F.sum(F.when(hit.isNotNull(), F.col(times))).cast("double")
    return df.agg(_rows_where(F.lit(True), times).alias("rows"), acc.alias("accuracy")).select(
        "rows", "accuracy", (F.col("accuracy") >= gate).alias("passes_gate"))


def _labels_spine(df: DataFrame, labels: list[int], name: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     labels: list[int] = C.CLASS_LABELS, times: str | None = None) -> DataFrame:
    """One row per actual label in ``labels``, one count column per predicted label."""
    counts = df.groupBy(label).agg(*[_rows_where(F.col(pred) == x, times).alias(f"predicted_{x}") for x in labels])
    spine = _labels_spine(df, labels, label)
    out = spine.join(counts, label, "left")
    return out.select(label, *[F.coalesce(F.col(f"predicted_{x}"), F.lit(0)).cast("long").alias(f"predicted_{x}")
                               for x in labels])


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          labels: list[int] = C.CLASS_LABELS, times: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and
    weighted averages.  Zero denominators give 0.  One aggregation pass."""
    l, p = F.col(label), F.col(pred)
    aggs = []
    for x in labels:
        aggs += [_rows_where((l == x) & (p == x), times).alias(f"tp{x}"), _rows_where(p == x, times).alias(f"pp{x}"),
                 _rows_where(l == x, times).alias(f"s{x}")]
    a = df.agg(_rows_where(F.lit(True), times).alias("n"), _rows_where(l == p, times).alias("correct"), *aggs)
    cols = []
    for x in labels:
        tp, pp, s = F.col(f"tp{x}"), F.col(f"pp{x}"), F.col(f"s{x}")
        cols += [_ratio(tp, pp).alias(f"p{x}"), _ratio(tp, s).alias(f"r{x}"),
                 _ratio(2 * tp, pp + s).alias(f"f{x}")]
    a = a.select("*", *cols)
    k = float(len(labels))

    def seq_sum(parts: list[Column]) -> Column:
        total = parts[0]
        for c in parts[1:]:
            total = total + c
        return total

    supp = seq_sum([F.col(f"s{x}") for x in labels])
    rows = [F.struct(F.lit(str(x)).alias("class_label"), F.col(f"p{x}").alias("precision"),
                     F.col(f"r{x}").alias("recall"), F.col(f"f{x}").alias("f1_score"),
                     F.col(f"s{x}").cast("long").alias("support")) for x in labels]
    rows.append(F.struct(F.lit("accuracy").alias("class_label"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), _ratio(F.col("correct"), F.col("n")).alias("f1_score"),
                         F.col("n").cast("long").alias("support")))
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        vals = []
        for m in ("p", "r", "f"):
            if weighted:
                num = seq_sum([F.col(f"{m}{x}") * F.col(f"s{x}") for x in labels])
                vals.append(F.when(supp == 0, F.lit(0.0)).otherwise(num / supp.cast("double")))
            else:
                vals.append(seq_sum([F.col(f"{m}{x}") for x in labels]) / F.lit(k))
        rows.append(F.struct(F.lit(name).alias("class_label"), vals[0].alias("precision"), vals[1].alias("recall"),
                             vals[2].alias("f1_score"), supp.cast("long").alias("support")))
    return a.select(F.inline(F.array(*rows)))


def under_routing(df: DataFrame, label: str = "label", pred: str = "prediction", times: str | None = None) -> DataFrame:
    """Actual tier 3 predicted as tier 1; alert when any."""
    n = _rows_where((F.col(label) == 3) & (F.col(pred) == 1), times)
    return df.agg(n.alias("under_routing_faults")).select(
        "under_routing_faults", (F.col("under_routing_faults") > 0).alias("alert"))


# --------------------------------------------------------------------------- D14-D16
def featurise_failures(failures: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """F12 with the fixed defaults (context True, base constraints 2, base format 1)."""
    keep = keep if keep is not None else ["id", "prompt", "assigned_tier", "true_tier"]
    return online_routing_features(failures, "prompt", keep=keep)


def training_matrix(baseline: DataFrame, failures: DataFrame,
                    replicas: int = C.FAILURE_REPLICAS) -> DataFrame:
    """Baseline rows (``tier_label`` as ``true_tier``) plus every failure repeated
    ``replicas`` times (a per-row generator, not a join).  Empty failures need no branch."""
    base = baseline.select(*FEATURES, F.col("tier_label").cast("int").alias("true_tier"),
                           F.lit("baseline").alias("source"))
    rep = failures.select(*FEATURES, F.col("true_tier").cast("int").alias("true_tier"),
                          F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("_copy"))
    return base.unionByName(rep.select(*FEATURES, "true_tier", F.lit("failure").alias("source")))
