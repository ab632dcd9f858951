"""DuckDB SQL equivalents of every registered query (the correctness oracle).

The fixture views of ``tierlens.fixtures`` are spelled out as CTEs so each query
reads only the pre-registered base tables.
"""

from __future__ import annotations

from ..constants import REGISTRY

FIXTURE_SQL = {
    "request_logs": """
SELECT event_id AS id, ts AS timestamp, sha256(concat('u', CAST(user_id AS VARCHAR))) AS prompt_hash,
  CASE WHEN event_id % 10 < 6 THEN 1 WHEN event_id % 10 < 9 THEN 2 ELSE 3 END AS complexity_tier_assigned,
  CASE WHEN event_id % 10 = 9 THEN 'gpt-4o' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'gpt-4o (Escalated)'
       WHEN event_id % 10 >= 6 THEN 'gpt-4o-mini' WHEN event_id % 10 = 5 THEN 'llama3.1:8b' ELSE 'claude-3-haiku' END AS routed_model,
  value / 100000 AS cost, CAST(event_id % 200 AS DOUBLE) / 100 AS latency,
  CASE WHEN event_id % 10 < 9 AND event_id % 5 = 1 THEN NULL ELSE 1 + CAST((event_id * 37) % 401 AS DOUBLE) / 100 END AS quality_score,
  CASE WHEN event_id % 10 < 9 AND event_type = 'error' AND event_id % 4 = 0 THEN 1 ELSE 0 END AS was_escalated
FROM events""",
    "verification_pairs": """
SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'classification' WHEN 2 THEN 'summarization' ELSE 'translation' END AS task_type,
  concat('Order ', CAST(o_orderkey AS VARCHAR), ' ', o_orderpriority) AS original_prompt,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 7
         WHEN 0 THEN concat('{"name": "', o_orderstatus, '", "amount": 1, "date": "d"}')
         WHEN 1 THEN concat('Sure! {"name": "', o_orderstatus, '",', chr(10), ' "date": "d", "amount": 2} done')
         WHEN 2 THEN concat('{"name": "', o_orderstatus, '"}')
         WHEN 3 THEN '{"name": 1} and {"date": 2, "amount": 3}'
         WHEN 4 THEN 'no structured output'
         WHEN 5 THEN '{}'
         ELSE '{''name'': 1}' END
       WHEN o_orderkey % 5 = 0 THEN 'something else' WHEN o_orderkey % 5 = 1 THEN ''
       ELSE concat('The label is ', upper(o_orderpriority), '.') END AS cheap_output,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('{"name": "', o_orderstatus, '", "date": "d", "amount": 1}') ELSE o_orderpriority END AS gold_output,
  CASE o_orderkey % 6 WHEN 0 THEN '{"score": 4, "reason": "ok"}' WHEN 1 THEN '{"score": 3.5}' WHEN 2 THEN '{"reason": "none"}'
       WHEN 3 THEN 'Score: 5' WHEN 4 THEN '{"score": "4.5", "reason": "str"}' ELSE '{"score": "high", "reason": "bad"}' END AS judge_output,
  o_totalprice / 100000000 AS cheap_cost, o_totalprice / 10000000 AS gold_cost,
  CAST(1 + o_orderkey % 2 AS INTEGER) AS predicted_tier,
  o_orderkey % 9 = 0 AS primary_failed
FROM orders""",
    "call_statuses": """
SELECT event_id AS request_id, CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 408
  WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 502 WHEN 7 THEN 503 END AS status
FROM events""",
    "call_attempts": """
SELECT event_id // 5 AS request_id, CAST(1 + (event_id % 5 + event_id // 5 % 3) % 5 AS INTEGER) AS attempt,
  CASE event_id * 7 % 13 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 400 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 502 WHEN 6 THEN 503
    WHEN 7 THEN 429 WHEN 8 THEN 503 WHEN 9 THEN 500 WHEN 10 THEN 404 END AS status,
  CASE WHEN event_id % 17 = 3 THEN NULL ELSE CAST(event_id * 3 % 29 AS DOUBLE) / 2 END AS latency_seconds
FROM events""",
    "routing_failure_events": """
SELECT doc_id AS id, text AS prompt, CAST(1 + doc_id % 2 AS INTEGER) AS assigned_tier,
  CAST(2 + doc_id % 2 AS INTEGER) AS true_tier
FROM documents""",
    "predictions": """
SELECT doc_id AS id, CAST(1 + doc_id % 3 AS INTEGER) AS label,
  CAST(1 + (doc_id + CASE WHEN doc_id % 11 < 2 THEN doc_id % 11 + 1 ELSE 0 END) % 3 AS INTEGER) AS prediction
FROM documents""",
    "provider_responses": """
SELECT l_orderkey * 10 + l_linenumber AS request_id,
  CASE l_orderkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'ollama' ELSE 'cohere' END AS provider,
  CASE l_orderkey % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-haiku' WHEN 2 THEN 'local-llama' ELSE 'unknown' END AS model_key,
  CASE l_orderkey % 4
    WHEN 0 THEN concat('{"choices": [{"message": {"content": ', CASE WHEN l_linenumber = 1 THEN 'null' ELSE concat('" ', l_returnflag, ' "') END,
         '}}], "usage": {"prompt_tokens": ', CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), ', "completion_tokens": ', CAST(l_linenumber AS VARCHAR), '}}')
    WHEN 1 THEN concat('{"content": [{"text": "', l_linestatus, '"}], "usage": {"input_tokens": ', CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), ', "output_tokens": ', CAST(l_linenumber AS VARCHAR), '}}')
    WHEN 2 THEN concat('{"message": {"content": "', l_returnflag, '"}', CASE WHEN l_linenumber = 2 THEN '' ELSE concat(', "prompt_eval_count": ', CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), ', "eval_count": ', CAST(l_linenumber AS VARCHAR)) END, '}')
    ELSE '{}' END AS raw_json
FROM lineitem""",
}


def registry_values_sql() -> str:
    rows = ", ".join(
        f"('{k}', '{p}', '{m}', CAST({i!r} AS DOUBLE), CAST({o!r} AS DOUBLE), CAST({lat!r} AS DOUBLE), '{q}')"
        for k, p, m, i, o, lat, q in REGISTRY)
    return (f"SELECT * FROM (VALUES {rows}) AS t(key, provider, model_id, cost_per_input_token, "
            f"cost_per_output_token, avg_latency_seconds, quality_tier)")


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH name AS (sql), ... body``."""
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {parts}\n{body}"


def fx(*names: str) -> dict[str, str]:
    return {n: FIXTURE_SQL[n] for n in names}


# --------------------------------------------------------------------------- text features in DuckDB
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_contains_any(lower_sql: str, kws) -> str:
    return "(" + " OR ".join(f"contains({lower_sql}, {_q(k)})" for k in kws) + ")"


def sql_count_present(lower_sql: str, kws) -> str:
    return "(" + " + ".join(f"CAST(contains({lower_sql}, {_q(k)}) AS INTEGER)" for k in kws) + ")"


def sql_regex_count(s_sql: str, pattern: str) -> str:
    return f"len(regexp_extract_all({s_sql}, {_q(pattern)}))"


def sql_token_count(p: str) -> str:
    from ..functions.text import PORTABLE_NON_WS_RUN
    return f"CAST(floor(CAST({sql_regex_count(p, PORTABLE_NON_WS_RUN)} AS DOUBLE) * CAST(1.3 AS DOUBLE)) AS INTEGER)"


def sql_strip(p: str) -> str:
    from ..functions.text import PORTABLE_STRIP_RE
    return f"regexp_replace({p}, {_q(PORTABLE_STRIP_RE)}, '', 'g')"


def sql_routing_features(p: str, ctx: str, base_c: str, base_f: str) -> str:
    from .. import constants as C
    from ..operators.features import unicode_digits
    lo = f"lower({p})"
    return ", ".join([
        f"{sql_token_count(p)} AS token_count",
        f"CAST({sql_contains_any(lo, C.ANALYZE_COMPARE_TERMS)} AS INTEGER) AS contains_analyze_compare",
        f"CAST({base_c} + {sql_regex_count(lo, unicode_digits(C.ROUTING_CONSTRAINT_RE))} AS INTEGER) AS constraint_count",
        f"CAST({ctx} AS INTEGER) AS context_provided",
        f"CAST(CASE WHEN {sql_contains_any(lo, C.FORMAT_LEVEL3_TERMS)} THEN greatest({base_f}, 3) "
        f"WHEN {sql_contains_any(lo, C.FORMAT_LEVEL2_TERMS)} THEN greatest({base_f}, 2) ELSE {base_f} END AS INTEGER) "
        f"AS output_format_complexity"])


def sql_diagnostic_features(p: str) -> str:
    from .. import constants as C
    from ..operators.features import unicode_digits
    lo = f"lower({p})"
    return ", ".join([
        f"{sql_token_count(p)} AS token_count",
        f"CAST({sql_count_present(lo, C.TIER1_KEYWORDS)} AS INTEGER) AS tier1_keyword_density",
        f"CAST({sql_count_present(lo, C.TIER2_KEYWORDS)} AS INTEGER) AS tier2_keyword_density",
        f"CAST({sql_count_present(lo, C.TIER3_KEYWORDS)} AS INTEGER) AS tier3_keyword_density",
        f"CAST({sql_regex_count(lo, unicode_digits(C.DIAGNOSTIC_CONSTRAINT_RE))} AS INTEGER) AS constraint_count",
        f"CAST({sql_contains_any(p, C.CODE_SYNTAX_MARKERS)} AS DOUBLE) AS contains_code_syntax",
        f"CAST({sql_token_count(p)} > {C.LONG_CONTEXT_TOKENS} AS DOUBLE) AS is_long_context"])


def sql_task_type(p: str) -> str:
    from .. import constants as C
    lo = f"lower({p})"
    return (f"CASE WHEN {sql_contains_any(lo, C.SUMMARIZATION_TERMS)} THEN 'summarization' "
            f"WHEN {sql_contains_any(lo, C.EXTRACTION_TERMS)} THEN 'extraction' ELSE 'classification' END")


def corpus_ctes() -> dict[str, str]:
    """D1 in DuckDB: 30 templates x documents, then the F12 features."""
    from .. import constants as C
    vals = ", ".join(f"({i}, {tier}, {_q(t)}, {str(ctx).upper()}, {bc}, {bf})"
                     for i, (tier, t, ctx, bc, bf) in enumerate(C.CORPUS_TEMPLATES))
    templates = (f"SELECT * FROM (VALUES {vals}) AS t(template_idx, tier_label, template, context_provided, "
                 f"base_constraints, base_format)")
    raw = (f"SELECT d.doc_id, t.template_idx, t.tier_label, "
           f"replace(t.template, {_q(C.CORPUS_PLACEHOLDER)}, d.text) || {_q(C.CORPUS_SUFFIX_BEFORE)} || d.source || "
           f"{_q(C.CORPUS_SUFFIX_AFTER)} AS prompt, t.context_provided, t.base_constraints, t.base_format "
           f"FROM documents d CROSS JOIN templates t")
    corpus = (f"SELECT doc_id, template_idx, prompt, tier_label, "
              f"{sql_routing_features('prompt', 'context_provided', 'base_constraints', 'base_format')} "
              f"FROM corpus_raw")
    return {"templates": templates, "corpus_raw": raw, "corpus": corpus}


# --------------------------------------------------------------------------- dimensions / verification in DuckDB
def policy_values_sql(policy) -> str:
    rows = ", ".join(f"({t}, {_q(r['tier_name'])}, {_q(r['description'])}, {_q(r['provider'])}, {_q(r['model_id'])}, "
                     f"{_q(r['fallback_model_id'])}, {r['max_tokens']}, CAST({r['temperature']!r} AS DOUBLE))"
                     for t, r in sorted(policy.routes.items()))
    return (f"SELECT * FROM (VALUES {rows}) AS t(route_tier, tier_name, description, policy_provider, policy_model_id, "
            f"fallback_model_id, max_tokens, temperature)")


def aliases_values_sql() -> str:
    from .. import constants as C
    rows = [(k, k) for k, *_ in C.REGISTRY] + list(C.MODEL_ALIASES)
    vals = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in rows)
    return f"SELECT * FROM (VALUES {vals}) AS t(model_ref, registry_key)"


def dims_ctes(policy) -> dict[str, str]:
    return {"policy": policy_values_sql(policy), "aliases": aliases_values_sql(), "registry": registry_values_sql()}


def sql_json_block(x: str) -> str:
    return f"regexp_extract(replace({x}, chr(10), ''), '(?s)\\{{.*\\}}', 0)"


def sql_extraction(cheap: str, gold: str) -> tuple[str, str, str]:
    """(passed, score, reason) SQL of V1."""
    from .. import constants as C
    cb, gb = sql_json_block(cheap), sql_json_block(gold)
    safe = lambda b: f"(CASE WHEN json_valid({b}) THEN {b} ELSE '{{}}' END)"
    miss = f"list_filter(json_keys({safe(gb)}), lambda k: NOT list_contains(json_keys({safe(cb)}), k))"
    cond = [f"{cb} = '' OR {gb} = ''", f"NOT (json_valid({cb}) AND json_valid({gb}))", f"len({miss}) > 0"]
    passed = f"CASE WHEN {cond[0]} THEN false WHEN {cond[1]} THEN false WHEN {cond[2]} THEN false ELSE true END"
    score = f"CASE WHEN {cond[0]} THEN 0.0 WHEN {cond[1]} THEN 0.0 WHEN {cond[2]} THEN 0.0 ELSE 1.0 END"
    reason = (f"CASE WHEN {cond[0]} THEN {_q(C.MSG_EXTRACT_NO_BLOCK)} WHEN {cond[1]} THEN {_q(C.MSG_EXTRACT_BAD_JSON)} "
              f"WHEN {cond[2]} THEN {_q(C.MSG_EXTRACT_MISSING)} || '[' || array_to_string(list_transform({miss}, "
              f"lambda k: '''' || k || ''''), ', ') || ']' ELSE {_q(C.MSG_EXTRACT_OK)} END")
    return passed, f"CAST({score} AS DOUBLE)", reason


def sql_missing_keys(cheap: str, gold: str) -> str:
    cb, gb = sql_json_block(cheap), sql_json_block(gold)
    safe = lambda b: f"(CASE WHEN json_valid({b}) THEN {b} ELSE '{{}}' END)"
    return f"list_filter(json_keys({safe(gb)}), lambda k: NOT list_contains(json_keys({safe(cb)}), k))"


def sql_classification(cheap: str, gold: str) -> tuple[str, str, str]:
    from .. import constants as C
    c = f"regexp_replace(lower({cheap}), '[^a-z0-9]', '', 'g')"
    g = f"regexp_replace(lower({gold}), '[^a-z0-9]', '', 'g')"
    ok = f"(contains({c}, {g}) OR contains({g}, {c}))"
    return (ok, f"CASE WHEN {ok} THEN 1.0 ELSE 0.0 END::DOUBLE",
            f"CASE WHEN {ok} THEN {_q(C.MSG_CLASS_OK)} ELSE {_q(C.MSG_CLASS_FAIL_BEFORE)} || {gold} || "
            f"{_q(C.MSG_CLASS_FAIL_AFTER)} END")


def _portable_float_re() -> str:
    from ..functions.text import PORTABLE_WS_CLASS
    d = r"[0-9](?:_?[0-9])*"
    return (r"^" + PORTABLE_WS_CLASS + r"*[+-]?(?:(?:(?:" + d + r")?\." + d + r"|" + d + r"\.?)(?:[eE][+-]?" + d
            + r")?|(?i:inf|infinity|nan))" + PORTABLE_WS_CLASS + r"*$")


def sql_judge(j: str, mode: str) -> tuple[str, str, str, str]:
    """(has_result, passed, score, reason) SQL of V5 (async) / V6 (sync)."""
    from .. import constants as C
    safe = f"(CASE WHEN json_valid({j}) THEN {j} ELSE '{{}}' END)"
    valid = f"json_valid({j})"
    is_obj = f"({valid} AND json_type({safe}) = 'OBJECT')"
    st = f"json_type({safe}, '$.score')"
    s_txt = f"json_extract_string({safe}, '$.score')"
    num = f"{st} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    str_ok = f"({st} = 'VARCHAR' AND regexp_matches({s_txt}, {_q(_portable_float_re())}))"
    score = (f"(CASE WHEN {st} IS NULL THEN 0.0::DOUBLE WHEN {st} = 'BOOLEAN' THEN "
             f"CAST(CAST(json_extract({safe}, '$.score') AS BOOLEAN) AS DOUBLE) "
             f"WHEN {num} THEN CAST(json_extract({safe}, '$.score') AS DOUBLE) "
             f"WHEN {str_ok} THEN TRY_CAST(replace({sql_strip(s_txt)}, '_', '') AS DOUBLE) END)")
    score_ok = f"({is_obj} AND ({st} IS NULL OR {st} = 'BOOLEAN' OR {num} OR {str_ok}))"
    rt = f"json_type({safe}, '$.reason')"
    reason = (f"(CASE WHEN {rt} = 'VARCHAR' THEN json_extract_string({safe}, '$.reason') WHEN {rt} = 'NULL' THEN 'None' "
              f"WHEN {rt} = 'BOOLEAN' THEN CASE WHEN CAST(json_extract({safe}, '$.reason') AS BOOLEAN) THEN 'True' "
              f"ELSE 'False' END WHEN {rt} IS NOT NULL THEN CAST(json_extract({safe}, '$.reason') AS VARCHAR) END)")
    passes = f"(NOT isnan({score}) AND {score} >= {C.MIN_SUMMARY_SCORE})"
    if mode == "async":
        has = f"(NOT {valid} OR {score_ok})"
        passed = f"CASE WHEN NOT {valid} THEN false WHEN {score_ok} THEN {passes} END"
        sc = f"CASE WHEN NOT {valid} THEN 0.0::DOUBLE WHEN {score_ok} THEN {score} END"
        rs = (f"CASE WHEN NOT {valid} THEN {_q(C.MSG_JUDGE_BAD_JSON_ASYNC)} WHEN {score_ok} THEN "
              f"coalesce({reason}, {_q(C.MSG_JUDGE_NO_REASON_ASYNC)}) END")
    else:
        ok = f"({valid} AND {score_ok})"
        has = "true"
        passed = f"CASE WHEN {ok} THEN {passes} ELSE false END"
        sc = f"CASE WHEN {ok} THEN {score} ELSE 0.0::DOUBLE END"
        rs = f"CASE WHEN {ok} THEN coalesce({reason}, '') ELSE {_q(C.MSG_JUDGE_FAILED_SYNC)} END"
    return has, passed, sc, rs


def sql_dispatch(task: str, cheap: str, gold: str, judge: str, mode: str) -> tuple[str, str, str, str]:
    """(has_result, passed, score, reason) SQL of V7."""
    from .. import constants as C
    e, c, s = sql_extraction(cheap, gold), sql_classification(cheap, gold), sql_judge(judge, mode)
    unk_has = "false" if mode == "async" else "true"
    unk = ("NULL", "NULL", "NULL") if mode == "async" else ("true", "1.0::DOUBLE", _q(C.MSG_UNKNOWN_TASK_SYNC))

    def case(i_e, i_c, i_s, i_u):
        return (f"CASE WHEN {task} = 'extraction' THEN {i_e} WHEN {task} = 'classification' THEN {i_c} "
                f"WHEN {task} = 'summarization' THEN {i_s} ELSE {i_u} END")
    has = case("true", "true", s[0], unk_has)
    return has, case(e[0], c[0], s[1], unk[0]), case(e[1], c[1], s[2], unk[1]), case(e[2], c[2], s[3], unk[2])
