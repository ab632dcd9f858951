"""Training, evaluation and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as fx_
from ..operators import corpus as D
from ..operators import forest as FO
from ..operators import prompts as P
from ..operators import training as TR
from ..operators.features import online_routing_features
from ..session import scratch_path, stored
from ..sources import model_store as MS
from ..sources.model_store import load_model, save_model
from ..tables import read
from . import oracle as O
from .q_text import FEATS, PROMPTS_SQL, corpus
from .registry import register


def _corpus_sql(body: str, **extra) -> str:
    return O.with_ctes(body, **O.corpus_ctes(), **extra)


# --------------------------------------------------------------------------- D6 / D7
@register("d6_stratified_split", _corpus_sql("""
SELECT s.doc_id, s.template_idx, s.tier_label,
  row_number() OVER (PARTITION BY s.tier_label ORDER BY s.h, s.doc_id, s.template_idx) <= (c.n * 2 + 5) // 10 AS is_test
FROM s JOIN c USING (tier_label)""",
    s="SELECT doc_id, template_idx, tier_label, sha256(concat_ws(':', '42', CAST(doc_id AS VARCHAR), "
      "CAST(template_idx AS VARCHAR))) AS h FROM corpus_raw",
    c="SELECT tier_label, count(*) AS n FROM s GROUP BY tier_label"))
def q_d6(spark, sf_dir):
    e = D.expand_templates(read(spark, sf_dir, "documents", spread=True)).select("doc_id", "template_idx", "tier_label")
    return TR.stratified_split(e, "tier_label", ["doc_id", "template_idx"])


@register("d7_class_weights", _corpus_sql("""
SELECT tier_label, count(*) AS n_label,
  CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight
FROM corpus_raw GROUP BY tier_label"""))
def q_d7(spark, sf_dir):
    e = D.expand_templates(read(spark, sf_dir, "documents", spread=True)).select("tier_label")
    return TR.class_weights(e, "tier_label")


# --------------------------------------------------------------------------- D10-D13 (prediction fixture)
def _pred_sql(body: str) -> str:
    return O.with_ctes(body, **O.fx("predictions"))


@register("d10_accuracy_gate", _pred_sql("""
SELECT count(*) AS rows, avg(CAST(label = prediction AS INTEGER)) AS accuracy,
  avg(CAST(label = prediction AS INTEGER)) >= 0.8 AS passes_gate FROM predictions"""))
def q_d10(spark, sf_dir):
    return TR.accuracy(fx_.predictions(spark, sf_dir))


@register("d11_confusion_matrix", _pred_sql("""
SELECT s.label, CAST(coalesce(c.p1, 0) AS BIGINT) AS predicted_1, CAST(coalesce(c.p2, 0) AS BIGINT) AS predicted_2,
  CAST(coalesce(c.p3, 0) AS BIGINT) AS predicted_3
FROM (SELECT unnest([1, 2, 3]) AS label) s LEFT JOIN
  (SELECT label, count_if(prediction = 1) AS p1, count_if(prediction = 2) AS p2, count_if(prediction = 3) AS p3
   FROM predictions GROUP BY label) c ON s.label = c.label"""))
def q_d11(spark, sf_dir):
    return TR.confusion_matrix(fx_.predictions(spark, sf_dir))


def _report_body() -> str:
    """D12 over a CTE ``predictions`` (label, prediction): the rest of a query after its CTEs."""
    labels = C.CLASS_LABELS
    counts = ", ".join(f"count_if(label = {x} AND prediction = {x}) AS tp{x}, count_if(prediction = {x}) AS pp{x}, "
                       f"count_if(label = {x}) AS s{x}" for x in labels)

    def r(num, den):
        return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"
    per = ", ".join(f"{r(f'tp{x}', f'pp{x}')} AS p{x}, {r(f'tp{x}', f's{x}')} AS r{x}, "
                    f"{r(f'2 * tp{x}', f'pp{x} + s{x}')} AS f{x}" for x in labels)
    supp = " + ".join(f"s{x}" for x in labels)
    parts = [f"SELECT '{x}' AS class_label, p{x} AS precision, r{x} AS recall, f{x} AS f1_score, "
             f"CAST(s{x} AS BIGINT) AS support FROM m" for x in labels]
    parts.append(f"SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {r('correct', 'n')}, "
                 f"CAST(n AS BIGINT) FROM m")
    macro = ["(" + " + ".join(f"{m}{x}" for x in labels) + f") / {float(len(labels))}" for m in "prf"]
    weighted = [f"CASE WHEN ({supp}) = 0 THEN 0.0 ELSE (" + " + ".join(f"{m}{x} * s{x}" for x in labels)
                + f") / CAST(({supp}) AS DOUBLE) END" for m in "prf"]
    parts.append(f"SELECT 'macro avg', {macro[0]}, {macro[1]}, {macro[2]}, CAST(({supp}) AS BIGINT) FROM m")
    parts.append(f"SELECT 'weighted avg', {weighted[0]}, {weighted[1]}, {weighted[2]}, CAST(({supp}) AS BIGINT) FROM m")
    return f""", a AS (SELECT count(*) AS n, count_if(label = prediction) AS correct, {counts} FROM predictions),
m AS (SELECT *, {per} FROM a)
""" + "\nUNION ALL\n".join(parts)


@register("d12_classification_report", _pred_sql(_report_body()))
def q_d12(spark, sf_dir):
    return TR.classification_report(fx_.predictions(spark, sf_dir))


@register("d13_under_routing", _pred_sql("""
SELECT count_if(label = 3 AND prediction = 1) AS under_routing_faults,
  count_if(label = 3 AND prediction = 1) > 0 AS alert FROM predictions"""))
def q_d13(spark, sf_dir):
    return TR.under_routing(fx_.predictions(spark, sf_dir))


# --------------------------------------------------------------------------- D14 / D15
@register("d14_failure_features", O.with_ctes(
    f"SELECT id, assigned_tier, true_tier, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} "
    f"FROM routing_failure_events", **O.fx("routing_failure_events")))
def q_d14(spark, sf_dir):
    return TR.featurise_failures(fx_.routing_failure_events(spark, sf_dir), keep=["id", "assigned_tier", "true_tier"])


@register("d15_training_matrix", _corpus_sql(
    f"""SELECT {FEATS}, tier_label AS true_tier, 'baseline' AS source FROM corpus
UNION ALL
SELECT {FEATS}, true_tier, 'failure' AS source FROM failures CROSS JOIN range(3)""",
    **O.fx("routing_failure_events"),
    failures=f"SELECT true_tier, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} FROM routing_failure_events"))
def q_d15(spark, sf_dir):
    failures = TR.featurise_failures(fx_.routing_failure_events(spark, sf_dir))
    return TR.training_matrix(corpus(spark, sf_dir), failures)


# --------------------------------------------------------------------------- D8 / D9 / D16 / S7
def _dealt_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return TR.dealt(docs, docs.count(), TR.FEATURE_ROWS)


def _first_rows(spark, sf_dir):
    """D6 over the corpus: features, label and ``is_test``."""
    c = D.labelled_corpus(_dealt_documents(spark, sf_dir)).drop("prompt")
    split = TR.stratified_split(c, "tier_label", ["doc_id", "template_idx"])
    return split.select(*C.FEATURE_COLUMNS, "tier_label", "is_test")


def _first_matrix(spark, sf_dir):
    """D6 over the corpus, written once: (matrix with ``is_test``, training rows per class)."""
    return TR.written_matrix(_first_rows(spark, sf_dir), "tier_label", "matrix", ~F.col("is_test"))


def _retrain_rows(spark, sf_dir):
    """D15 over the corpus and the failures."""
    docs = _dealt_documents(spark, sf_dir)
    failures = TR.featurise_failures(fx_.routing_failures_from(docs))
    return TR.training_matrix(D.labelled_corpus(docs), failures)


def _retrain_matrix(spark, sf_dir):
    """D15 over the corpus and the failures, written once, and its rows per class."""
    return TR.written_matrix(_retrain_rows(spark, sf_dir), "true_tier", "retrain-matrix")


def _train_first_model(spark, sf_dir):
    """The forest of the training rows, and all rows with ``is_test``, equal ones counted."""
    tally, counts = TR.written_tally(_first_rows(spark, sf_dir), "tier_label", "tally", ~F.col("is_test"))
    return TR.train_forest(tally.where("NOT is_test"), "tier_label", counts, TR.TIMES), tally


def _labelled(scored, label, *more):
    return scored.select(F.col(label).alias("label"), F.col("predicted_tier").alias("prediction"), *more)


@register("d8_train_and_evaluate")
def q_d8(spark, sf_dir):
    """D6 -> D7 -> D8 on the corpus, then D10/D11/D13 on the held-out rows."""
    model, tally = _train_first_model(spark, sf_dir)
    path = scratch_path(spark, "model-v1")
    save_model(model, path, C.VERSION_FIRST_TRAIN)
    test = stored(_labelled(TR.score(tally.where("is_test"), model, ["tier_label", TR.TIMES]), "tier_label", TR.TIMES), "held-out-scores")
    acc = TR.accuracy(test, times=TR.TIMES)
    cm = TR.confusion_matrix(test, times=TR.TIMES)
    ur = TR.under_routing(test, times=TR.TIMES)
    # one-row reports attached as scalar subqueries (no cross join)
    return cm.select(F.lit(C.VERSION_FIRST_TRAIN).alias("version_tag"), "*",
                     acc.select("accuracy").scalar().alias("accuracy"),
                     acc.select("passes_gate").scalar().alias("passes_gate"),
                     ur.select("under_routing_faults").scalar().alias("under_routing_faults"))


@register("d12_trained_report")
def q_d12_trained(spark, sf_dir):
    """D12 of the trained forest on the held-out rows, scored from its node table."""
    model, tally = _train_first_model(spark, sf_dir)
    scored = FO.score_nodes(tally.where("is_test"), FO.node_table(model), ["tier_label", TR.TIMES])
    return TR.classification_report(_labelled(scored, "tier_label", TR.TIMES), times=TR.TIMES)


@register("d9_default_route", O.with_ctes(
    "SELECT conv_id, 1 AS predicted_tier, CAST(1.0 AS DOUBLE) AS confidence FROM prompts",
    prompts="SELECT DISTINCT conv_id FROM conversations"))
def q_d9_default(spark, sf_dir):
    """D9 without a model artifact: every prompt goes to tier 1 with confidence 1.0."""
    prompts = P.assemble_prompts(read(spark, sf_dir, "conversations"))
    model, _ = load_model(spark, scratch_path(spark, "absent-model"))
    return TR.score_prompts(prompts, model, "conv_id")


@register("d9_model_route")
def q_d9_model(spark, sf_dir):
    """D9 over the assembled conversation prompts with a trained model that was saved and loaded."""
    trained, _ = _train_first_model(spark, sf_dir)
    path = scratch_path(spark, "model-route")
    save_model(trained, path, C.VERSION_FIRST_TRAIN)
    model, _ = load_model(spark, path)
    prompts = P.assemble_prompts(read(spark, sf_dir, "conversations"))
    return TR.score_prompts(prompts, model, "conv_id")


@register("d16_retrain")
def q_d16(spark, sf_dir):
    """D15 -> D7 -> D8 -> training accuracy -> S7 save (version 1.1.0_auto_updated) -> reload."""
    tally, counts = TR.written_tally(_retrain_rows(spark, sf_dir), "true_tier", "retrain-tally")
    model = TR.train_forest(tally, "true_tier", counts, TR.TIMES)
    path = scratch_path(spark, "model-retrain")
    save_model(model, path, C.VERSION_RETRAIN)
    reloaded, meta = load_model(spark, path)
    acc = TR.accuracy(_labelled(TR.score(tally, reloaded, ["true_tier", TR.TIMES]), "true_tier", TR.TIMES), times=TR.TIMES)
    return meta.select("version_tag", "input_features",
                       acc.select("rows").scalar().alias("training_rows"),
                       acc.select("accuracy").scalar().alias("training_accuracy"))


# --------------------------------------------------------------------------- D8 / D9 / D16 on a forest that SQL can grow too
def _level_forest_sql(train: str, label: str, rows: str, keep: str) -> str:
    """CTEs cuts, weights, leaves and scored: the forest of ``operators.forest.level_forest``
    (five trees, three levels), written from its definition."""
    feats = ["token_count", "contains_analyze_compare", "constraint_count", "context_provided", "output_format_complexity"]

    def node(t: int) -> str:
        bits = [f"CASE WHEN {feats[(t + i) % 5]} <= cut{(t + i) % 5} THEN 0 ELSE {4 >> i} END" for i in range(3)]
        return f"8 + {' + '.join(bits)}"
    cuts = ", ".join(f"floor(avg({f})) + 0.5 AS cut{i}" for i, f in enumerate(feats))
    at = "UNION ALL ".join(f"SELECT {t} AS tree, {node(t)} AS node, {label} AS c FROM {train}, cuts " for t in range(5))
    share = ", ".join(f"x{c} / (0.0::DOUBLE + x1 + x2 + x3) AS s{c}" for c in (1, 2, 3))
    x = ", ".join(f"count_if(c = {c}) * coalesce(any_value(w{c}), 0.0::DOUBLE) AS x{c}" for c in (1, 2, 3))
    w = ", ".join(f"(SELECT count(*) FROM {train})::DOUBLE / ((SELECT count(DISTINCT {label}) FROM {train}) * nullif(count_if({label} = {c}), 0))::DOUBLE AS w{c}"
                  for c in (1, 2, 3))
    joins = " ".join(f"LEFT JOIN leaves l{t} ON l{t}.tree = {t} AND l{t}.node = {node(t)}" for t in range(5))
    votes = ", ".join("0.0::DOUBLE + " + " + ".join(f"coalesce(l{t}.s{c}, 0.0::DOUBLE)" for t in range(5)) + f" AS v{c}" for c in (1, 2, 3))
    return f""", cuts AS (SELECT {cuts} FROM {train}), weights AS (SELECT {w} FROM {train}),
leaves AS (SELECT tree, node, {share} FROM (SELECT tree, node, {x} FROM ({at}) a, weights GROUP BY tree, node)),
votes AS (SELECT {keep}, {votes} FROM (SELECT r.*, cuts.* FROM {rows} r, cuts) r {joins}),
scored AS (SELECT {keep}, CAST(CASE WHEN v1 >= v2 AND v1 >= v3 THEN 1 WHEN v2 >= v3 THEN 2 ELSE 3 END AS INTEGER) AS predicted_tier,
  greatest(v1, v2, v3) / (0.0::DOUBLE + v1 + v2 + v3) AS confidence FROM votes)
"""


_SPLIT = dict(
    sh="SELECT *, sha256(concat_ws(':', '42', CAST(doc_id AS VARCHAR), CAST(template_idx AS VARCHAR))) AS h FROM corpus",
    sn="SELECT tier_label, count(*) AS n FROM corpus GROUP BY tier_label",
    split="SELECT sh.*, row_number() OVER (PARTITION BY tier_label ORDER BY h, doc_id, template_idx) <= (n * 2 + 5) // 10 AS is_test "
          "FROM sh JOIN sn USING (tier_label)",
    train="SELECT * FROM split WHERE NOT is_test", test="SELECT * FROM split WHERE is_test")


@register("d8_level_forest_report", _corpus_sql(
    _level_forest_sql("train", "tier_label", "test", "tier_label") + ", predictions AS (SELECT tier_label AS label, predicted_tier AS prediction FROM scored)"
    + _report_body(), **_SPLIT))
def q_d8_level(spark, sf_dir):
    """D6 -> D7 -> a forest of fixed shape -> node-table scoring of the held-out rows -> D12."""
    matrix, counts = _first_matrix(spark, sf_dir)
    nodes = FO.level_forest(matrix.where("NOT is_test"), "tier_label", counts=counts)
    return TR.classification_report(_labelled(FO.score_nodes(matrix.where("is_test"), nodes, ["tier_label"]), "tier_label"))


@register("d9_level_forest_route", _corpus_sql(
    _level_forest_sql("train", "tier_label", "online", "conv_id") + "SELECT conv_id, predicted_tier, confidence FROM scored", **_SPLIT, prompts=PROMPTS_SQL,
    online=f"SELECT conv_id, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} FROM prompts"))
def q_d9_level(spark, sf_dir):
    """D9 over the assembled conversation prompts from a node table."""
    matrix, counts = _first_matrix(spark, sf_dir)
    nodes = FO.level_forest(matrix.where("NOT is_test"), "tier_label", counts=counts)
    prompts = P.assemble_prompts(read(spark, sf_dir, "conversations"))
    return FO.score_nodes(online_routing_features(prompts, keep=["conv_id"]), nodes, ["conv_id"])


@register("d16_level_forest_retrain", _corpus_sql(
    _level_forest_sql("matrix", "true_tier", "matrix", "true_tier") + """
SELECT count(*) AS training_rows, avg(CAST(true_tier = predicted_tier AS INTEGER)) AS training_accuracy,
  count_if(true_tier = 3 AND predicted_tier = 1) AS under_routing_faults FROM scored""",
    **O.fx("routing_failure_events"),
    failures=f"SELECT true_tier, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} FROM routing_failure_events",
    matrix=f"SELECT {FEATS}, tier_label AS true_tier FROM corpus UNION ALL SELECT {FEATS}, true_tier FROM failures CROSS JOIN range(3)"))
def q_d16_level(spark, sf_dir):
    """D15 -> D7 -> a forest of fixed shape -> accuracy on the training rows."""
    matrix, counts = _retrain_matrix(spark, sf_dir)
    nodes = FO.level_forest(matrix, "true_tier", counts=counts)
    scored = _labelled(FO.score_nodes(matrix, nodes, ["true_tier"]), "true_tier")
    return scored.agg(F.count(F.lit(1)).alias("training_rows"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("training_accuracy"),
                      F.count_if((F.col("label") == 3) & (F.col("prediction") == 1)).alias("under_routing_faults"))


@register("s7_gated_route", _corpus_sql(
    _level_forest_sql("train", "tier_label", "both_rows", "conv_id, tier_label") + """, held AS
(SELECT avg(CAST(tier_label = predicted_tier AS INTEGER)) AS accuracy FROM scored WHERE conv_id IS NULL)
SELECT conv_id, CASE WHEN accuracy >= 0.8 THEN predicted_tier ELSE 1 END AS predicted_tier,
  CASE WHEN accuracy >= 0.8 THEN confidence ELSE 1.0::DOUBLE END AS confidence, accuracy >= 0.8 AS promoted
FROM scored, held WHERE conv_id IS NOT NULL""", **_SPLIT, prompts=PROMPTS_SQL,
    both_rows=f"SELECT NULL AS conv_id, tier_label, {FEATS} FROM test UNION ALL "
              f"SELECT conv_id, NULL, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} FROM prompts"))
def q_s7_gated(spark, sf_dir):
    """A version is written, becomes current only if its held-out accuracy passes the gate
    (D10), and prompts are scored by whatever is current then."""
    matrix, counts = _first_matrix(spark, sf_dir)
    nodes = FO.level_forest(matrix.where("NOT is_test"), "tier_label", counts=counts)
    path = scratch_path(spark, "model-store")
    accuracy = TR.accuracy(_labelled(FO.score_nodes(matrix.where("is_test"), nodes, ["tier_label"]), "tier_label")).first().accuracy
    promoted = MS.promote(spark, path, MS.write_version(path, C.VERSION_FIRST_TRAIN, nodes=nodes), accuracy)
    current, _ = MS.load_nodes(spark, path)
    prompts = P.assemble_prompts(read(spark, sf_dir, "conversations"))
    features = online_routing_features(prompts, keep=["conv_id"])
    routed = TR.score(features, None, ["conv_id"]) if current is None else FO.score_nodes(features, current, ["conv_id"])
    return routed.withColumn("promoted", F.lit(promoted))
