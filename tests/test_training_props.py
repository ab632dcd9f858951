"""Property checks for the forest (D8, D9, D16, S7): no bit-level oracle exists."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.operators import training as TR
from tierlens.session import scratch_path
from tierlens.sources.model_store import load_model, save_model

from .conftest import SF_SMALL


def small_matrix(spark):
    rows = [(10 * i + t, t % 2, t + i % 3, 1, 1 + (t > 1), t) for t in (1, 2, 3) for i in range(30)]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in C.FEATURE_COLUMNS) + ", tier_label int")


def test_forest_scores_probabilities_and_tiers(spark):
    m = small_matrix(spark)
    model = TR.train_forest(m, "tier_label")
    out = model.transform(m).select(vector_to_array("probability").alias("p"))
    sums = [sum(r.p) for r in out.collect()]
    assert all(abs(s - 1.0) < 1e-9 for s in sums)
    scored = TR.score(m, model, ["tier_label"]).collect()
    assert all(1 <= r.predicted_tier <= 3 and 0 < r.confidence <= 1 for r in scored)
    acc = sum(r.predicted_tier == r.tier_label for r in scored) / len(scored)
    assert acc >= C.ACCURACY_GATE


def test_model_round_trip_and_default_route(spark):
    m = small_matrix(spark)
    model = TR.train_forest(m, "tier_label")
    path = scratch_path(spark, "t-model")
    save_model(model, path, C.VERSION_RETRAIN)
    loaded, meta = load_model(spark, path)
    assert meta.collect()[0].version_tag == C.VERSION_RETRAIN
    a = TR.score(m, model, ["tier_label"]).select("predicted_tier", "confidence").collect()
    b = TR.score(m, loaded, ["tier_label"]).select("predicted_tier", "confidence").collect()
    assert a == b
    none, _ = load_model(spark, scratch_path(spark, "absent"))
    d = TR.score(m, none, ["tier_label"]).select("predicted_tier", "confidence").distinct().collect()
    assert [(r.predicted_tier, r.confidence) for r in d] == [(1, 1.0)]


def test_training_matrix_replicates_failures(spark):
    base = small_matrix(spark)
    fails = base.limit(4).withColumnRenamed("tier_label", "true_tier")
    mat = TR.training_matrix(base, fails)
    assert mat.count() == 90 + 12
    empty = TR.training_matrix(base, fails.where("false"))
    assert empty.count() == 90


def test_registered_rows_only_queries_run(spark):
    import __spark_entry__ as E
    d16 = E.queries()["d16_retrain"](spark, SF_SMALL).collect()[0]
    assert d16.version_tag == C.VERSION_RETRAIN and 0.0 <= d16.training_accuracy <= 1.0
    d9 = E.queries()["d9_model_route"](spark, SF_SMALL)
    assert d9.where(~F.col("predicted_tier").between(1, 3)).count() == 0


def test_model_route_scores_the_loaded_model(spark, monkeypatch):
    from tierlens.plans import q_training

    loaded, scored = [], []
    monkeypatch.setattr(q_training, "_train_first_model", lambda s, d: (TR.train_forest(small_matrix(s), "tier_label"), None))
    monkeypatch.setattr(q_training, "load_model", lambda *a: loaded.append(load_model(*a)) or loaded[-1])
    score = TR.score_prompts
    monkeypatch.setattr(TR, "score_prompts", lambda p, model, key: scored.append(model) or score(p, model, key))
    out = q_training.q_d9_model(spark, SF_SMALL).collect()
    assert len(loaded) == 1 and scored[0] is loaded[0][0]
    assert out and all(1 <= r.predicted_tier <= 3 and 0 < r.confidence <= 1 for r in out)
