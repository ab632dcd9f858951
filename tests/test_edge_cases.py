"""Literal edge cases (FIXTURES.md section 3) with expected values."""

import pytest
from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.functions.text import prompt_hash
from tierlens.operators import features as Fe
from tierlens.operators import prompts as P
from tierlens.operators import routing as R
from tierlens.operators import telemetry as T
from tierlens.operators import training as TR
from tierlens.operators import verify as V
from tierlens.sources.dims import load_policy, model_registry

GOLD = '{"vessel": "Aurora", "port": "Narvik", "tons": 820.5}'


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(col.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("cheap,gold,passed,reason", [
    ('{"vessel": "Aurora", "port": "Narvik"}', GOLD, False, "Missing critical extraction keys: ['tons']"),
    ('{"a":1} {"b":2}', '{"a":1}', False, C.MSG_EXTRACT_BAD_JSON),
    ("{'a':1}", '{"a":1}', False, C.MSG_EXTRACT_BAD_JSON),
    ('{"a":1,}', '{"a":1}', False, C.MSG_EXTRACT_BAD_JSON),
    ('{"a":NaN}', '{"a":1}', True, C.MSG_EXTRACT_OK),
    ('{"x": 1}', '{}', True, C.MSG_EXTRACT_OK),
    ("no braces", '{"a":1}', False, C.MSG_EXTRACT_NO_BLOCK),
    ('Sure: {"a":1,\n"b":2} ok', '{"b": 0, "a": 0}', True, C.MSG_EXTRACT_OK),
    ('{"a":1,"a":2}', '{"a":1,"b":1,"b":2}', False, "Missing critical extraction keys: ['b']"),
])
def test_v1_extraction(spark, cheap, gold, passed, reason):
    r = one(spark, V.verify_extraction(F.col("c"), F.col("g")), c=cheap, g=gold)
    assert (r.passed, r.reason) == (passed, reason)
    assert r.score == (1.0 if passed else 0.0)


@pytest.mark.parametrize("cheap,gold,passed", [
    ("Based on the text, the category is High_Urgency.", "highurgency", True),
    ("", "anything", True), ("anything", "", True), ("low", "high", False),
])
def test_v3_classification(spark, cheap, gold, passed):
    r = one(spark, V.verify_classification(F.col("c"), F.col("g")), c=cheap, g=gold)
    assert r.passed == passed
    if not passed:
        assert r.reason == f"Label mismatch. Expected semantic match with: '{gold}'"


@pytest.mark.parametrize("verdict,async_r,sync_r", [
    ('{"score": 4}', (True, 4.0, "No reason provided"), (True, 4.0, "")),
    ('{"reason":"x"}', (False, 0.0, "x"), (False, 0.0, "x")),
    ("Score: 5", (False, 0.0, C.MSG_JUDGE_BAD_JSON_ASYNC), (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ('```json\n{"score": 5}\n```', (False, 0.0, C.MSG_JUDGE_BAD_JSON_ASYNC), (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ('{"score":"high"}', None, (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ('{"score":"4d"}', None, (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ('{"score":null}', None, (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ("[1]", None, (False, 0.0, C.MSG_JUDGE_FAILED_SYNC)),
    ('{"score":"4.5"}', (True, 4.5, "No reason provided"), (True, 4.5, "")),
    ('{"score":true}', (False, 1.0, "No reason provided"), (False, 1.0, "")),
    ('{"score":1,"score":5}', (True, 5.0, "No reason provided"), (True, 5.0, "")),
    ('{"score":" 1_0 "}', (True, 10.0, "No reason provided"), (True, 10.0, "")),
    ('{"score":"nan"}', (False, None, "No reason provided"), (False, None, "")),
])
def test_v5_v6_judge(spark, verdict, async_r, sync_r):
    a = one(spark, V.judge_verdict_async(F.col("j")), j=verdict)
    s = one(spark, V.judge_verdict_sync(F.col("j")), j=verdict)

    def cmp(row, exp):
        if exp[1] is None:          # NaN score
            assert row.passed == exp[0] and row.reason == exp[2] and row.score != row.score
        else:
            assert (row.passed, row.score, row.reason) == exp
    if async_r is None:
        assert a is None
    else:
        cmp(a, async_r)
    cmp(s, sync_r)


def test_v4_judge_prompt_keeps_percent(spark):
    r = one(spark, V.judge_prompt(F.col("p"), F.col("c")), p="100% sure", c="%s")
    assert "ORIGINAL TEXT/PROMPT:\n        100% sure\n" in r and "SUMMARY:\n        %s\n" in r
    assert r.endswith('{"score": 4, "reason": "short explanation"}\n        ')


@pytest.mark.parametrize("prompt,tokens,t1,t2,t3,cons", [
    ("Extract all email addresses from this text: 'Please contact support@company.com or sales@company.com "
     "for inquiries.' Format as JSON.", 22, 3, 0, 0, 0),
    ("Summarize the following customer support log into 3 bullet points. Classify whether the user sentiment "
     "is frustrated or neutral.", 24, 0, 3, 0, 0),
    ("Write a Python script that implements an async pipeline with exponential backoff retries. Evaluate the "
     "memory footprint of using a thread pool versus asyncio, and think step-by-step through the failure "
     "scenarios.", 40, 0, 0, 2, 0),
])
def test_f13_tier_prompts(spark, prompt, tokens, t1, t2, t3, cons):
    df = spark.createDataFrame([(prompt,)], "prompt string")
    r = Fe.diagnostic_features(df).collect()[0]
    assert (r.token_count, r.tier1_keyword_density, r.tier2_keyword_density, r.tier3_keyword_density,
            r.constraint_count) == (tokens, t1, t2, t3, cons)


def test_f1_f3_literals(spark):
    texts = ["Extract the company names: 'Google bought YouTube in 2006 for $1.65B.' Return as clean JSON.",
             "1. must 2. should musty only commonly", "", "  \t\n ", "a b\u001cc"]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string")
    rows = Fe.routing_features(df, context_provided=F.lit(True), base_constraints=F.lit(0),
                               base_format=F.lit(1)).collect()
    assert [r.token_count for r in rows] == [int(len(t.split()) * 1.3) for t in texts]
    assert rows[0].token_count == 19 and rows[0].constraint_count == 1
    assert rows[1].constraint_count == 7
    assert rows[2].token_count == 0


def test_p2_hash(spark):
    import hashlib
    texts = ["", "  abc\t\n", " abc ", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = [r[0] for r in df.select(prompt_hash("p")).collect()]
    assert got == [hashlib.sha256(t.strip().encode()).hexdigest() for t in texts]
    assert got[0].startswith("e3b0c44298fc") and got[1] == got[2] == got[3]


def test_p3_recurrence(spark):
    import datetime as dt
    rows = [(1, dt.datetime(2026, 1, 1), "Calculate quarterly revenue churn across our EMEA division.", "claude-3-haiku"),
            (2, dt.datetime(2026, 1, 2), "Write an enterprise multi-tenant database connection pool manager in Rust.", "gpt-4o"),
            (3, dt.datetime(2026, 1, 3), "Calculate quarterly revenue churn across our EMEA division.", "gpt-4o-mini")]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, prompt string, routed_model string")
    logs = df.select("id", "timestamp", prompt_hash("prompt").alias("prompt_hash"), "routed_model")
    out = sorted((r.requests, r.distinct_models) for r in P.prompt_recurrence(logs).collect())
    assert out == [(1, 1), (2, 2)]


def test_p1_assembly_fallbacks(spark):
    rows = [(1, 0, "user", ""), (1, 1, "user", ""),                 # two empty user turns -> ' '
            (2, 0, "user", ""), (2, 1, "assistant", "x"),           # empty user -> last message
            (3, 0, "system", "s"), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (3, 3, "user", "c"),
            (4, 0, "system", "only system")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.prompt for r in P.assemble_prompts(df, turns_per_chunk=2).collect()}
    assert got == {1: " ", 2: "x", 3: "a c", 4: "only system"}


def test_r1_r3_r4_r9(spark):
    policy = load_policy()
    df = spark.createDataFrame([(t,) for t in [1, 2, 3, 99]], "tier int")
    got = {r.tier: (r.route_tier, r.policy_model_id) for r in R.resolve_route(df, policy).collect()}
    assert got[99] == (3, "gpt-4o") and got[1][1] == "claude-3-haiku-20240307"
    lint = sorted(r.model_id for r in R.policy_lint(policy, spark).collect())
    assert lint == ["claude-3-5-sonnet-20241022", "claude-3-5-sonnet-20241022", "claude-3-haiku-20240307"]
    assert R.policy_lint(policy, spark, aliases=True).count() == 0
    c = spark.createDataFrame([("gpt-4o", 100, 150)], "model_key string, input_tokens long, output_tokens long")
    assert R.with_cost(c).collect()[0].cost == pytest.approx(0.00175, abs=1e-15)
    st = spark.createDataFrame([(s,) for s in [200, 429, 500, 404, 503]], "status int")
    assert [r[0] for r in st.select(R.retry_eligible("status", policy)).collect()] == [False, True, True, False, True]


def test_s5_s6_validation(tmp_path, spark):
    with pytest.raises(ValueError):
        model_registry(spark, [("k", "p", "m", 0.0, 0.0, 1.0, "premium")])
    bad = tmp_path / "p.yaml"
    bad.write_text("version: '1'\nlast_modified: 'x'\nrouting_map:\n  1: {tier_name: a}\nruntime_policies: {}\n")
    with pytest.raises(ValueError):
        load_policy(str(bad))
    with pytest.raises(FileNotFoundError):
        load_policy(str(tmp_path / "missing.yaml"))


def test_t3_t4_t8(spark):
    rows = [(1, "gpt-4o-mini", 1.0, 5.0), (2, "claude-3-haiku", 1.0, None), (3, "llama3.1:8b", 1.0, 1.0),
            (4, "gpt-4o (Escalated)", 1.0, 4.99)]
    df = spark.createDataFrame(rows, "id long, routed_model string, cost double, quality_score double")
    b = [r[1] for r in sorted(df.select("id", T.baseline_cost_col()).collect())]
    assert b == [25.0, 30.0, 30.0, 1.0]
    h = {r.bin: r["count"] for r in T.quality_histogram(df).collect()}
    assert len(h) == 20 and h[19] == 2 and h[0] == 1 and sum(h.values()) == 3
    empty = T.headline_kpis(df.where("false")).collect()[0]
    assert (empty.requests, empty.actual_spend, empty.baseline_spend, empty.savings_pct) == (0, 0.0, 0.0, 0.0)


def test_d6_d7_exact_split_and_weights(spark):
    rows = [(k, 1 + k % 3) for k in range(210)]
    df = spark.createDataFrame(rows, "k long, label int")
    s = TR.stratified_split(df, "label", ["k"])
    got = sorted((r.label, r.is_test, r["count"]) for r in s.groupBy("label", "is_test").count().collect())
    assert got == [(lbl, t, n) for lbl in (1, 2, 3) for t, n in ((False, 56), (True, 14))]
    assert sorted(r.k for r in s.where("is_test").collect()) == sorted(r.k for r in
                                                                     TR.stratified_split(df, "label", ["k"])
                                                                     .where("is_test").collect())
    w = {r.label: r.weight for r in TR.class_weights(df, "label").collect()}
    assert w == {1: 1.0, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_d6_split_equals_window_over_label(spark, bits):
    """Boundary-bucket split == row_number over the whole label, also when buckets
    are crowded (few bits) and for labels with 1-3 rows (targets 0 and 1)."""
    from pyspark.sql import Window
    rows = [(k, 1 + k % 3) for k in range(600)] + [(1000, 7), (1001, 8), (1002, 8), (1003, 8), (1004, 9)]
    df = spark.createDataFrame(rows, "k long, label int")
    got = {r.k: r.is_test for r in TR.stratified_split(df, "label", ["k"], bucket_bits=bits).collect()}
    n = df.groupBy("label").count().withColumnRenamed("count", "n")
    rn = F.row_number().over(Window.partitionBy("label").orderBy(TR.split_hash(["k"]), "k"))
    exp = {r.k: r.t for r in df.join(n, "label").select("k", (rn <= F.floor((F.col("n") * 2 + 5) / 10)).alias("t"))
           .collect()}
    assert len(got) == len(rows) and got == exp


def test_d11_d12_never_predicted_class(spark):
    rows = [(1, 1), (1, 2), (2, 2), (3, 2), (3, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cm = {r.label: (r.predicted_1, r.predicted_2, r.predicted_3) for r in TR.confusion_matrix(df).collect()}
    assert cm == {1: (1, 1, 0), 2: (0, 1, 0), 3: (1, 1, 0)}
    rep = {r.class_label: r for r in TR.classification_report(df).collect()}
    assert rep["3"].precision == 0.0 and rep["3"].f1_score == 0.0 and rep["3"].support == 2
    assert rep["accuracy"].f1_score == pytest.approx(2 / 5)
    assert TR.under_routing(df).collect()[0].under_routing_faults == 1


def test_py_list_repr_sql_and_column_forms_match_python(spark):
    from tierlens.functions.json import py_list_repr
    keys = ["a", "it's", 'say "hi"', "both ' and \"", "back\\slash", "", "ΟΔΟΣ"]
    odd = ["tab\tx"]   # non-printable escapes are a documented difference from repr
    df = spark.createDataFrame([(keys,), ([],), (odd,)], "k array<string>")
    rows = df.select(py_list_repr("k").alias("s"), py_list_repr(F.col("k")).alias("c")).collect()
    assert [(r.s, r.c) for r in rows[:2]] == [(repr(keys), repr(keys)), ("[]", "[]")]
    assert rows[2].s == rows[2].c


def test_keep_rows_is_a_filter_without_pushdown(spark):
    from tierlens.functions.rows import keep_rows
    df = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, None, "c"), (4, True, None)],
                               "id long, f boolean, s string")
    kept = keep_rows(df, F.col("f"))
    assert kept.columns == df.columns
    assert sorted(kept.collect()) == sorted(df.where("f").collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan
