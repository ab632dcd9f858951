"""Quality verification over paired outputs (V1-V9).

Each check is a struct column (passed, score, reason, task_type) computed with
built-in string / regex / JSON functions, so verification of a billion pairs is a
single narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.json import is_json, py_list_repr, top_level_keys
from ..functions.rows import keep_rows
from ..functions.text import py_strip

BLOCK_RE = r"(?s)\{.*\}"
# Python float() text: optional white space and sign, digits with single
# underscores between them, optional fraction and exponent, or inf / infinity / nan.
_D = r"[0-9](?:_?[0-9])*"
PY_FLOAT_RE = (r"(?U)^[\s\x{1C}-\x{1F}]*[+-]?(?:(?:(?:" + _D + r")?\." + _D + r"|" + _D + r"\.?)(?:[eE][+-]?" + _D
               + r")?|(?i:inf|infinity|nan))[\s\x{1C}-\x{1F}]*$")


def _result(passed: Column, score: Column, reason: Column, task: Column | str) -> Column:
    t = F.lit(task) if isinstance(task, str) else task
    return F.struct(passed.cast("boolean").alias("passed"), score.cast("double").alias("score"),
                    reason.cast("string").alias("reason"), t.alias("task_type"))


def json_block(text: Column) -> Column:
    """Greedy first ``{`` ... last ``}`` after dropping newlines; '' when absent."""
    return F.regexp_extract(F.replace(text, F.lit("\n"), F.lit("")), BLOCK_RE, 0)


def missing_keys(cheap: Column, gold: Column) -> Column:
    """V2: gold top-level keys absent from the cheap output, in gold order."""
    return F.array_except(top_level_keys(json_block(gold)), top_level_keys(json_block(cheap)))


def extraction_from(cb: Column, gb: Column, cb_ok: Column, gb_ok: Column, ck: Column, gk: Column,
                    miss: Column | None = None, miss_text: Column | None = None) -> Column:
    """V1 verdict from pre-computed parts: blocks, their validity, their key lists
    (and, optionally, the missing keys and their rendering)."""
    miss = F.array_except(gk, ck) if miss is None else miss
    no_block = (cb == "") | (gb == "")
    bad = ~(cb_ok & gb_ok)
    return (F.when(no_block, _result(F.lit(False), F.lit(0.0), F.lit(C.MSG_EXTRACT_NO_BLOCK), "extraction"))
             .when(bad, _result(F.lit(False), F.lit(0.0), F.lit(C.MSG_EXTRACT_BAD_JSON), "extraction"))
             .when(F.size(miss) > 0, _result(F.lit(False), F.lit(0.0),
                                             F.concat(F.lit(C.MSG_EXTRACT_MISSING),
                                                      py_list_repr(miss) if miss_text is None else miss_text),
                                             "extraction"))
             .otherwise(_result(F.lit(True), F.lit(1.0), F.lit(C.MSG_EXTRACT_OK), "extraction")))


def verify_extraction(cheap: Column, gold: Column) -> Column:
    """V1: JSON key coverage of the cheap output against the gold output."""
    cb, gb = json_block(cheap), json_block(gold)
    return extraction_from(cb, gb, is_json(cb), is_json(gb), top_level_keys(cb), top_level_keys(gb))


def _label_norm(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def verify_classification(cheap: Column, gold: Column) -> Column:
    """V3: normalised labels agree when either contains the other ('' always does)."""
    c, g = _label_norm(cheap), _label_norm(gold)
    ok = c.contains(g) | g.contains(c)
    return F.when(ok, _result(F.lit(True), F.lit(1.0), F.lit(C.MSG_CLASS_OK), "classification")).otherwise(
        _result(F.lit(False), F.lit(0.0), F.concat(F.lit(C.MSG_CLASS_FAIL_BEFORE), gold, F.lit(C.MSG_CLASS_FAIL_AFTER)),
                "classification"))


def judge_prompt(original_prompt: Column, cheap: Column) -> Column:
    """V4: the fixed judge template around the prompt and the cheap summary
    (``concat``, not ``format_string``: the texts may contain ``%``)."""
    return F.concat(F.lit(C.JUDGE_PROMPT_HEAD), original_prompt, F.lit(C.JUDGE_PROMPT_MIDDLE), cheap,
                    F.lit(C.JUDGE_PROMPT_TAIL))


_VERDICT_SCHEMA = "score variant, reason variant"


def _parse_verdict(verdict: Column) -> Column:
    return F.from_json(verdict, _VERDICT_SCHEMA, {"allowSingleQuotes": "false"})


def judge_from_parts(verdict: Column, valid: Column, parsed: Column, st: Column, rt: Column) -> Column:
    """Judge verdict struct(valid, score_ok, score, reason) from its parts: the text,
    its strict validity, the parsed (score, reason) variants and their type names."""
    is_obj = valid & py_strip(verdict).startswith("{")
    sv, rv = parsed["score"], parsed["reason"]
    s_text = F.try_variant_get(sv, "$", "string")
    numeric = st.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | st.startswith("DECIMAL")
    str_ok = (st == "STRING") & F.regexp_like(s_text, F.lit(PY_FLOAT_RE))
    score = (F.when(sv.isNull(), F.lit(0.0))
              .when(st == "BOOLEAN", F.try_variant_get(sv, "$", "boolean").cast("double"))
              .when(numeric, F.try_variant_get(sv, "$", "double"))
              .when(str_ok & s_text.rlike("(?i)nan"), F.lit(float("nan")))
              .when(str_ok, F.replace(py_strip(s_text), F.lit("_"), F.lit("")).try_cast("double")))
    score_ok = is_obj & (sv.isNull() | (st == "BOOLEAN") | numeric | str_ok)
    reason = (F.when(rt == "STRING", F.try_variant_get(rv, "$", "string"))
               .when(rt == "VOID", F.lit("None"))
               .when(rt == "BOOLEAN", F.when(F.try_variant_get(rv, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
               .when(rv.isNotNull(), F.to_json(rv)))
    return F.struct(valid.alias("valid"), F.coalesce(score_ok, F.lit(False)).alias("score_ok"),
                    score.alias("score"), reason.alias("reason"))


def judge_parse(verdict: Column) -> Column:
    """Parsed judge verdict: struct(valid, score_ok, score, reason)."""
    parsed = _parse_verdict(verdict)
    return judge_from_parts(verdict, is_json(verdict), parsed, F.schema_of_variant(parsed["score"]),
                            F.schema_of_variant(parsed["reason"]))


def _passes(score: Column) -> Column:
    return ~F.isnan(score) & (score >= C.MIN_SUMMARY_SCORE)


def judge_async_from(j: Column) -> Column:
    """V5 from a parsed verdict: invalid JSON fails with 0.0; a valid verdict with an
    unusable score (or not an object) gives NULL = no result; otherwise pass iff
    score >= 4.0."""
    return (F.when(~j["valid"], _result(F.lit(False), F.lit(0.0), F.lit(C.MSG_JUDGE_BAD_JSON_ASYNC), "summarization"))
             .when(j["score_ok"], _result(_passes(j["score"]), j["score"],
                                          F.coalesce(j["reason"], F.lit(C.MSG_JUDGE_NO_REASON_ASYNC)),
                                          "summarization")))


def judge_sync_from(j: Column) -> Column:
    """V6 from a parsed verdict: as V5 but reason defaults to '' and every failure is
    a 0.0 fail."""
    ok = j["valid"] & j["score_ok"]
    return F.when(ok, _result(_passes(j["score"]), j["score"], F.coalesce(j["reason"], F.lit("")), "summarization")
                  ).otherwise(_result(F.lit(False), F.lit(0.0), F.lit(C.MSG_JUDGE_FAILED_SYNC), "summarization"))


def judge_verdict_async(verdict: Column) -> Column:
    """V5 on a verdict text."""
    return judge_async_from(judge_parse(verdict))


def judge_verdict_sync(verdict: Column) -> Column:
    """V6 on a verdict text."""
    return judge_sync_from(judge_parse(verdict))


def _dispatch_from(task: Column, ext: Column, cls: Column, j: Column, mode: str) -> Column:
    summ = judge_async_from(j) if mode == "async" else judge_sync_from(j)
    unknown = (F.lit(None) if mode == "async" else
               _result(F.lit(True), F.lit(1.0), F.lit(C.MSG_UNKNOWN_TASK_SYNC), task))
    return (F.when(task == "extraction", ext).when(task == "classification", cls)
             .when(task == "summarization", summ).otherwise(unknown))


def dispatch(task: Column, cheap: Column, gold: Column, judge: Column, mode: str = "async") -> Column:
    """V7 as one column expression: route each row to V1 / V3 / V5-V6 by task type.
    Unknown task: NULL (skipped) in async mode, a 1.0 pass in sync mode."""
    return _dispatch_from(task, verify_extraction(cheap, gold), verify_classification(cheap, gold),
                          judge_parse(judge), mode)


VERIFIED_TASKS = ("extraction", "classification", "summarization")


def staged_verdicts(df: DataFrame, mode: str = "async", task: str = "task_type", cheap: str = "cheap_output",
                    gold: str = "gold_output", judge: str = "judge_output", drop_no_result: bool = True) -> DataFrame:
    """V7 over a table as staged projections, adding the struct column ``_verdict``.

    Each payload is parsed once: the JSON blocks, their validity and key lists, and
    the parsed judge verdict are columns of their own (only on rows of the task that
    needs them), and the verdict reads them by reference.  In async mode rows with
    no result are dropped after the verdict (see below); with
    ``drop_no_result=False`` they stay, with a NULL ``_verdict``, for an aggregate
    that counts only non-NULL verdicts.
    """
    t = F.col(task)
    # Spark does not share a subexpression between the branches of a CASE, so every
    # parse that a branch reads more than once is a column of an earlier projection.
    s1 = df.select("*", F.when(t == "extraction", json_block(F.col(cheap))).alias("_cb"),
                   F.when(t == "extraction", json_block(F.col(gold))).alias("_gb"),
                   F.when(t == "summarization", F.col(judge)).alias("_jt"))
    s1 = s1.select("*", is_json(F.col("_jt")).alias("_jv"), _parse_verdict(F.col("_jt")).alias("_jp"))
    s1 = s1.select("*", F.schema_of_variant(F.col("_jp.score")).alias("_jst"),
                   F.schema_of_variant(F.col("_jp.reason")).alias("_jrt"))
    j = judge_from_parts(F.col("_jt"), F.col("_jv"), F.col("_jp"), F.col("_jst"), F.col("_jrt"))
    s2 = s1.select("*", is_json(F.col("_cb")).alias("_cbv"), is_json(F.col("_gb")).alias("_gbv"),
                   top_level_keys(F.col("_cb")).alias("_ck"), top_level_keys(F.col("_gb")).alias("_gk"),
                   F.when(t == "summarization", j).alias("_j"))
    s2 = s2.select("*", F.array_except(F.col("_gk"), F.col("_ck")).alias("_miss"))
    ext = extraction_from(F.col("_cb"), F.col("_gb"), F.col("_cbv"), F.col("_gbv"), F.col("_ck"), F.col("_gk"),
                          F.col("_miss"), py_list_repr("_miss"))
    v = _dispatch_from(t, ext, verify_classification(F.col(cheap), F.col(gold)), F.col("_j"), mode)
    out = s2.select(*df.columns, v.alias("_verdict"))
    if mode == "async" and drop_no_result:
        # not a filter: it would be pushed below the staged projections (see keep_rows)
        out = keep_rows(out, F.col("_verdict").isNotNull())
    return out


def verify_pairs(pairs: DataFrame, mode: str = "async", key: str = "pair_id", task: str = "task_type",
                 cheap: str = "cheap_output", gold: str = "gold_output", judge: str = "judge_output",
                 keep: list[str] | None = None) -> DataFrame:
    """V7 over a table; rows without a result (async skip / no result) are dropped."""
    v = staged_verdicts(pairs.select(key, task, cheap, gold, judge, *(keep or [])), mode, task, cheap, gold, judge)
    return v.select(key, *(keep or []), "_verdict.task_type", "_verdict.passed", "_verdict.score",
                    "_verdict.reason")


def verdict_errors(pairs: DataFrame, key: str = "pair_id", task: str = "task_type",
                   judge: str = "judge_output") -> DataFrame:
    """V5 error output: summarization rows whose verdict gave no result."""
    v = (pairs.where(F.col(task) == "summarization")
         .select(key, judge_verdict_async(F.col(judge)).alias("v"), F.col(judge)))
    return keep_rows(v, F.col("v").isNull()).select(key, F.col(judge).alias("judge_output"))


def captured_savings(verdicts: DataFrame, gold_cost: str = "gold_cost", cheap_cost: str = "cheap_cost") -> Column:
    """V8: savings on a pass = gold cost - cheap cost (may be negative); NULL otherwise."""
    return F.when(F.col("passed"), F.col(gold_cost) - F.col(cheap_cost))


def failure_feed(verdicts: DataFrame, key: str, prompt: str, assigned_tier: Column, true_tier: Column) -> DataFrame:
    """V9: failed verdicts as routing-failure rows (input of S2 / D14)."""
    return keep_rows(verdicts, ~F.col("passed")).select(
        F.col(key).alias("id"), F.col(prompt).alias("prompt"),
        assigned_tier.cast("int").alias("assigned_tier"), true_tier.cast("int").alias("true_tier"))
