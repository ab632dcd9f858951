"""D6 by refined histograms, D7 weights without a shuffle, forests as node tables."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.operators import forest as FO
from tierlens.operators import selection as SE
from tierlens.operators import training as TR
from tierlens.plans import q_training as Q
from tierlens.session import scratch_path, stored

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_window(df, keys):
    n = df.groupBy("label").count().withColumnRenamed("count", "n")
    rn = F.row_number().over(Window.partitionBy("label").orderBy(TR.split_hash(keys), *keys))
    return df.join(n, "label").select(*keys, "label", (rn <= F.floor((F.col("n") * 2 + 5) / 10)).alias("t"))


# --------------------------------------------------------------------------- D6
@pytest.mark.parametrize("bits, least", [(3, 2), (4, 40), (20, 1)])
def test_split_refines_histograms(spark, monkeypatch, bits, least):
    monkeypatch.setattr(SE, "LIST", least)
    rows = [(k, str(k % 7), f"c{k % 3}") for k in range(700)] + [(2000, None, "d"), (2001, "x", "d"), (2002, "x", "e")]
    df = spark.createDataFrame(rows, "k long, j string, label string").repartition(5)
    got = {(r.k, r.j): r.is_test for r in TR.stratified_split(df, "label", ["k", "j"], bucket_bits=bits).collect()}
    assert got == {(r.k, r.j): r.t for r in by_window(df, ["k", "j"]).collect()}


def test_split_of_repeated_keys_and_missing_labels(spark, monkeypatch):
    monkeypatch.setattr(SE, "LIST", 3)
    rows = [(1, 1)] * 40 + [(2, 1)] * 25 + [(k, 1) for k in range(3, 20)] + [(5, 2)] * 10 + [(9, None)] * 6
    df = spark.createDataFrame(rows, "k long, label int")
    out = TR.stratified_split(df, "label", ["k"], bucket_bits=6)
    n = {(r.label, r.is_test): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    assert n == {(1, True): 16, (1, False): 66, (2, True): 2, (2, False): 8, (None, False): 6}
    same = lambda d, c: sorted((r.k, r.label, r[c], r["count"]) for r in d.where("label is not null").groupBy("k", "label", c).count().collect())
    assert same(out, "is_test") == same(by_window(df, ["k"]), "t")
    assert TR.stratified_split(df.where("false"), "label", ["k"]).count() == 0


def test_split_reads_once_and_moves_nothing(spark):
    df = stored(spark.range(3000).select("id", (F.col("id") % 3).alias("label"), F.lit("x" * 50).alias("body")), "t-split")
    out = TR.stratified_split(df, "label", ["id"])
    text = plan(out)
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text and "Window" not in text
    assert out.where("is_test").count() == 600


def test_too_many_classes_are_an_error(spark):
    df = spark.range(SE.MAX_CLASSES + 5).select("id", F.col("id").alias("label"))
    for run in (lambda: TR.stratified_split(df, "label", ["id"], test_fraction=1.0), lambda: SE.class_counts(df, "label"),
                lambda: TR.class_weights(df, "label").collect()):
        with pytest.raises(Exception, match="classes"):
            run()


# --------------------------------------------------------------------------- D7
def test_weights_are_literals(spark):
    rows = [(float(i), 1, 2, 1, 1, 1 + (i > 3) + (i > 20)) for i in range(60)] + [(0.0, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" if c == "token_count" else f"{c} int" for c in C.FEATURE_COLUMNS) + ", tier_label int")
    table, counts = TR.written_matrix(df, "tier_label", "t-matrix")
    assert counts == {1: 4, 2: 17, 3: 39} == SE.class_counts(df, "tier_label")
    fit = TR.weighted_matrix(table, "tier_label", counts)
    text = plan(fit)
    assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1
    want = {r.tier_label: r.weight for r in TR.class_weights(df.where("tier_label is not null"), "tier_label").collect()}
    assert {int(r.label_idx) + 1: r.weight for r in fit.collect()} == want and fit.count() == 60
    part, counts = TR.written_matrix(df, "tier_label", "t-matrix", F.col("token_count") >= 4)
    assert counts == {1: 0, 2: 17, 3: 39} and part.count() == 61
    halves = {r.weight for r in TR.weighted_matrix(part.where("token_count >= 4"), "tier_label", counts).collect()}
    assert halves == {56 / (2 * 17), 56 / (2 * 39)}                        # an absent class does not count
    other, counts = TR.written_matrix(df.withColumn("tier_label", F.col("tier_label") + 6), "tier_label", "t-matrix")
    assert counts == {7: 4, 8: 17, 9: 39}                                  # labels beyond the list are counted again


def test_weights_are_counted_in_one_pass(spark):
    df = stored(spark.range(100).select((F.col("id") % 4).alias("label")), "t-weights")
    assert plan(TR.class_weights(df, "label")).count("FileScan") == 1


# --------------------------------------------------------------------------- forests as tables
@pytest.fixture(scope="module")
def fitted(spark):
    matrix, counts = Q._first_matrix(spark, SF_SMALL)
    model = TR.train_forest(matrix.where("NOT is_test"), "tier_label", counts)
    path = scratch_path(spark, "t-nodes")
    FO.node_table(model).write.parquet(path)
    return model, matrix.withColumn("r", F.monotonically_increasing_id()), spark.read.parquet(path), path


def test_node_table_scores_like_the_forest(spark, fitted):
    model, matrix, nodes, _ = fitted
    assert nodes.select("tree").distinct().count() == C.FOREST_TREES
    odd = matrix.select("r", *[F.when(F.col("r") % 97 == i, None).otherwise(F.col(c)).alias(c) for i, c in enumerate(C.FEATURE_COLUMNS)])
    for df in (matrix, odd):
        a = {r.r: (r.predicted_tier, r.confidence) for r in TR.score(df, model, ["r"]).collect()}
        b = {r.r: (r.predicted_tier, r.confidence) for r in FO.score_nodes(df, nodes, ["r"]).collect()}
        assert a == b
    assert {(r.predicted_tier, r.confidence) for r in FO.score_nodes(odd.where("r % 97 = 0"), nodes, ["r"]).collect()} == {(1, 1.0)}
    assert "Python" not in plan(FO.score_nodes(matrix, nodes, ["r"]))


def test_duckdb_scores_from_the_same_node_table(spark, fitted):
    _, matrix, nodes, path = fitted
    rows = scratch_path(spark, "t-rows")
    matrix.write.parquet(rows)
    f = "CASE n.feature " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(C.FEATURE_COLUMNS)) + " END"
    got = duckdb.sql(f"""
        WITH RECURSIVE n AS (SELECT * FROM read_parquet('{path}/*.parquet')), m AS (SELECT * FROM read_parquet('{rows}/*.parquet')),
        walk AS (SELECT m.*, n.tree, n.node, n.feature, n.shares FROM m, n WHERE n.node = 0
                 UNION ALL
                 SELECT w.* EXCLUDE (tree, node, feature, shares), k.tree, k.node, k.feature, k.shares
                 FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node
                 JOIN n k ON k.tree = w.tree AND k.node = CASE WHEN {f.replace('n.feature', 'w.feature')} <= n.threshold THEN n."left" ELSE n."right" END
                 WHERE w.feature >= 0),
        v AS (SELECT r, list_reduce(list(shares[1] ORDER BY tree), lambda a, b: a + b) AS a, list_reduce(list(shares[2] ORDER BY tree), lambda a, b: a + b) AS b,
                     list_reduce(list(shares[3] ORDER BY tree), lambda a, b: a + b) AS c FROM walk WHERE feature < 0 GROUP BY r)
        SELECT r, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END, greatest(a, b, c) / (a + b + c) FROM v""").fetchall()
    want = {r.r: (r.predicted_tier, r.confidence) for r in FO.score_nodes(matrix, nodes, ["r"]).collect()}
    assert len(got) == len(want)
    assert all(want[r][0] == t and abs(want[r][1] - p) < 1e-12 for r, t, p in got)


def test_level_forest_shapes(spark):
    cols = ", ".join(f"{c} int" for c in C.FEATURE_COLUMNS) + ", tier_label int"
    empty = spark.createDataFrame([], cols)
    nodes = FO.level_forest(empty, "tier_label")
    assert nodes.count() == 0
    one = spark.createDataFrame([(5, 0, 1, 1, 2, 2), (9, 1, 4, 1, 2, 3)], cols)
    assert [(r.predicted_tier, r.confidence) for r in FO.score_nodes(one, nodes, ["tier_label"]).collect()] == [(1, 1.0)] * 2
    nodes = FO.level_forest(one, "tier_label")
    assert nodes.count() == 5 * 15 and nodes.where("feature < 0").count() == 5 * 8
    got = FO.score_nodes(one, nodes, ["tier_label"]).collect()
    assert all(r.predicted_tier == r.tier_label and r.confidence > 0.5 for r in got)
    with pytest.raises(ValueError, match="nodes"):
        FO.Forest(spark.range(FO.MAX_NODES + 1))
