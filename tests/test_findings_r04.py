"""Tests of the findings of the round: the forest is grown from counted rows."""

import math
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.operators import corpus as D
from tierlens.operators import features as FE
from tierlens.operators import forest as FO
from tierlens.operators import grow
from tierlens.operators import training as TR
from tierlens.plans import q_training as Q
from tierlens.session import scratch_path

from .conftest import SF_SMALL

ROWS = ", ".join(f"{c} int" for c in C.FEATURE_COLUMNS) + ", tier_label int"


def some_rows(spark, n=6000, null_features=False):
    """Rows that often repeat, with NULL labels and more than 256 token counts."""
    rng = np.random.default_rng(5)
    cols = [rng.integers(0, 700, n) // rng.integers(1, 9, n), rng.integers(0, 2, n), rng.poisson(2, n), np.ones(n, int), rng.integers(1, 4, n)]
    label = 1 + (cols[0] + 40 * cols[1] + rng.integers(0, 60, n) > 90).astype(int) + (cols[2] + rng.integers(0, 3, n) > 5)
    rows = [[int(x) for x in r] for r in zip(*cols, label)]
    for i in range(0, n, 97) if null_features else ():
        rows[i][i % 5] = None
    for i in range(0, n, 501):
        rows[i][5] = None
    return spark.createDataFrame(rows + rows[: n // 3], ROWS)


def nodes_of(model):
    return FO.node_table(model).orderBy("tree", "node").collect()


def same_nodes(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert tuple(x)[:3] == tuple(y)[:3] and (x.left, x.right) == (y.left, y.right)
        assert x.threshold == y.threshold
        assert (x.shares is None) == (y.shares is None) and (x.shares is None or np.allclose(x.shares, y.shares, rtol=0, atol=1e-9))


def test_f1_without_draws_the_trees_are_spark_mls(spark):
    train = TR.weighted_matrix(some_rows(spark), "tier_label")
    assembler, rf = TR.forest_pipeline().getStages()
    rf.setBootstrap(False).setFeatureSubsetStrategy("all").setNumTrees(2)
    counted = train.groupBy(*C.FEATURE_COLUMNS, "label_idx", "weight").agg(F.count("*").alias("n"))
    got = nodes_of(PipelineModel([assembler, grow.fit_counted(counted, rf, C.FEATURE_COLUMNS)]))
    assert len(got) > 60
    same_nodes(got, nodes_of(PipelineModel([assembler, rf.fit(assembler.transform(train))])))


def test_f1_the_forest_does_not_depend_on_partitions_or_on_counting_first(spark):
    """Draws were made for each row in the order of a partition, and kept for all rows."""
    rows = some_rows(spark)
    counts = {1: 0, 2: 0, 3: 0} | {r.tier_label: r["count"] for r in rows.where("tier_label is not null").groupBy("tier_label").count().collect()}
    tally = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    one, many, counted = (nodes_of(m) for m in (TR.train_forest(rows.repartition(1), "tier_label"), TR.train_forest(rows.repartition(5), "tier_label", counts),
                                                TR.train_forest(tally, "tier_label", counts, "times")))
    assert one == many == counted and len({r.tree for r in one}) == C.FOREST_TREES


def test_f1_equal_rows_are_drawn_like_single_ones(spark):
    """n equal rows are drawn Poisson(n) times by a tree (mean n, variance n), not n times one draw (variance n * n)."""
    n = 40_000
    rows = spark.range(n).select(*[(F.col("id") % 2).cast("int").alias(c) for c in C.FEATURE_COLUMNS], (1 + F.col("id") % 3).cast("int").alias("tier_label"))
    model = TR.train_forest(rows, "tier_label")
    path = scratch_path(spark, "f1-draws")
    model.stages[-1].write().save(path)
    drawn = [r.rawCount for r in spark.read.parquet(f"{path}/data").select("nodeData.*").where("id = 0").collect()]
    assert len(drawn) == C.FOREST_TREES and len(set(drawn)) > 100
    assert abs(np.mean(drawn) - n) < 5 * math.sqrt(n / len(drawn)) and 0.6 * n < np.var(drawn) < 1.6 * n
    assert model.stages[-1].getOrDefault("numTrees") == C.FOREST_TREES and model.stages[-1].getOrDefault("maxDepth") == C.FOREST_DEPTH


def test_f1_a_tally_holds_every_row(spark):
    rows = some_rows(spark, 900, null_features=True).withColumn("is_test", F.col("token_count") % 5 == 0)
    tally, counts = TR.written_tally(rows, "tier_label", "t-tally", ~F.col("is_test"))
    assert tally.count() < rows.count()
    again = tally.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
    assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    assert counts == {r.tier_label: r["count"] for r in rows.where("not is_test and tier_label is not null").groupBy("tier_label").count().collect()}
    with pytest.raises(ValueError, match="counts"):
        TR.train_forest(tally, "tier_label", times="times")
    with pytest.raises(Exception, match="no row"):
        TR.train_forest(rows.where("false"), "tier_label")
    with pytest.raises(ValueError, match="NULL"):                  # Spark ML refuses them too
        TR.train_forest(rows, "tier_label")


@pytest.mark.parametrize("some", ["true", "false", "label is null"])
def test_f1_f4_reports_of_counted_rows(spark, some):
    values = [(x, y, n) for i, (x, y) in enumerate((x, y) for x in (1, 2, 3, 4, None) for y in (1, 2, 3, None)) for n in (i % 4 + 1, 2)]
    counted = spark.createDataFrame(values, "label int, prediction int, times long").where(some)
    rows = counted.select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
    for report in (TR.accuracy, TR.confusion_matrix, TR.classification_report, TR.under_routing):
        assert report(counted, times="times").collect() == report(rows).collect()
        assert [(f.name, f.dataType) for f in report(counted, times="times").schema] == [(f.name, f.dataType) for f in report(rows).schema]


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_f1_every_held_out_row_is_evaluated(spark):
    held = Q.q_d8(spark, SF_SMALL).collect()
    n = {r.label: r.predicted_1 + r.predicted_2 + r.predicted_3 for r in held}
    assert n == {1: 2 * documents(spark), 2: 2 * documents(spark), 3: 2 * documents(spark)}
    right = sum(r[f"predicted_{r.label}"] for r in held)
    assert all(abs(r.accuracy - right / sum(n.values())) < 1e-12 for r in held)


def test_f2_every_conversation_is_routed_by_the_forest(spark):
    routed = Q.q_d9_model(spark, SF_SMALL)
    assert routed.count() == spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id").distinct().count()
    assert routed.where("confidence < 1 and predicted_tier between 1 and 3").count() > 0


def test_f3_every_row_of_the_matrix_is_trained_on(spark):
    got = Q.q_d16(spark, SF_SMALL).first()
    assert got.training_rows == 33 * documents(spark) and 0.5 < got.training_accuracy < 1


def test_f4_every_held_out_row_is_reported(spark):
    report = {r.class_label: r for r in Q.q_d12_trained(spark, SF_SMALL).collect()}
    assert report["accuracy"].support == report["weighted avg"].support == 6 * documents(spark)
    assert [report[x].support for x in "123"] == [2 * documents(spark)] * 3


def test_f1_f2_f3_f4_code_of_expanded_rows_is_compiled(spark):
    """The JVM interprets a method of more than 8000 bytes for ever; merging 14 keyword flags a row was 10575."""
    rows = D.labelled_corpus(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).drop("prompt").groupBy(*C.FEATURE_COLUMNS, "tier_label").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) >= 2 and max(sizes) <= 8000


def test_f1_f2_f3_f4_grouped_keywords_give_the_features_of_whole_prompts(spark, monkeypatch):
    """Also for a template that is featurised on its whole prompt, and for texts that are empty or end in odd white space."""
    monkeypatch.setattr(C, "CORPUS_TEMPLATES", [*C.CORPUS_TEMPLATES[:6], (2, "join {data}JSON and {data}", True, 1, 1)])
    texts = [None, "", " ", "\u2003", "compare\u00a0json", "Nested\x1c", "must\U0001d7d9.", "csv", "abstract syntax", " \U00020000", "\u3000bullet only 3. never"]
    docs = spark.createDataFrame([(i, t, d) for i, t in enumerate(texts) for d in ("s", "tree", None)], "doc_id long, text string, source string")
    got = D.labelled_corpus(docs).where("prompt is not null")
    want = FE.routing_features(D.expand_templates(docs), keep=["doc_id", "template_idx", "prompt", "tier_label"]).where("prompt is not null")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 7 * 2 * (len(texts) - 1)
    assert {D.template_parts(x[1])[0] for x in C.CORPUS_TEMPLATES} >= {"full", "split"}
