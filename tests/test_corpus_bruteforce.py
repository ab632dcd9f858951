"""The corpus featurisation (document summarised once, merged with template parts)
against a brute-force Python computation on whole prompts, on adversarial payloads:
keywords and digits at both ends, Unicode white space, empty text, final sigma."""

import re

import pytest
from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.operators import corpus as D

PAYLOADS = [
    "", " ", "x", "analyze", "json", "1.", "5.must", "never' only", " lead and trail ",
    "ΟΔΟΣ", "Σ", "end with sigma Σ", "bullet\ttable\ncsv", "compare and contrast", "do not ΣΑΣ.",
    "'quoted'", "{data}", "think step by step: summary of schema", "mustshouldo not alwayshould",
    "tl;dr format: yes", "١. arabic digit", "x\u001cy", "evaluate", "source code\r\n",
]
# domains sit between two fixed texts; these probe both of those junctions
SOURCES = ["src7", "", " ", "not", "code", "json", "Σ", "ΟΣ ", "1.", "must", "step", " and contrast", "x\u001c"]


def source_of(i):
    return SOURCES[i % len(SOURCES)]


def brute(prompt, ctx, base_c, base_f):
    lo = prompt.lower()
    words = lo.split()
    fmt = base_f
    if any(k in lo for k in C.FORMAT_LEVEL3_TERMS):
        fmt = max(fmt, 3)
    elif any(k in lo for k in C.FORMAT_LEVEL2_TERMS):
        fmt = max(fmt, 2)
    return (int(len(words) * 1.3), int(any(k in lo for k in C.ANALYZE_COMPARE_TERMS)),
            base_c + len(re.findall(C.ROUTING_CONSTRAINT_RE, lo)), int(ctx), fmt)


def brute_diag(prompt):
    lo = prompt.lower()
    tokens = int(len(lo.split()) * 1.3)
    return (tokens, sum(k in lo for k in C.TIER1_KEYWORDS), sum(k in lo for k in C.TIER2_KEYWORDS),
            sum(k in lo for k in C.TIER3_KEYWORDS), len(re.findall(C.DIAGNOSTIC_CONSTRAINT_RE, lo)),
            1.0 if any(m in prompt for m in C.CODE_SYNTAX_MARKERS) else 0.0, 1.0 if tokens > 2500 else 0.0)


def expected_rows(payloads):
    out = {}
    for i, text in enumerate(payloads):
        for t, (tier, tpl, ctx, bc, bf) in enumerate(C.CORPUS_TEMPLATES):
            prompt = tpl.replace("{data}", text) + C.CORPUS_SUFFIX_BEFORE + source_of(i) + C.CORPUS_SUFFIX_AFTER
            out[(i, t)] = (brute(prompt, ctx, bc, bf), brute_diag(prompt))
    return out


@pytest.fixture(scope="module")
def payload_df(spark):
    return spark.createDataFrame([(i, t, source_of(i)) for i, t in enumerate(PAYLOADS)],
                                 "doc_id long, text string, source string")


def test_routing_features_equal_brute_force(payload_df):
    exp = expected_rows(PAYLOADS)
    got = {(r.doc_id, r.template_idx): (r.token_count, r.contains_analyze_compare, r.constraint_count,
                                        r.context_provided, r.output_format_complexity)
           for r in D.labelled_corpus(payload_df).collect()}
    assert len(got) == len(PAYLOADS) * 30
    bad = {k: (got[k], exp[k][0]) for k in got if got[k] != exp[k][0]}
    assert not bad


def test_diagnostic_features_equal_brute_force(payload_df):
    exp = expected_rows(PAYLOADS)
    got = {(r.doc_id, r.template_idx): tuple(r[2:]) for r in D.corpus_diagnostics(payload_df).collect()}
    bad = {k: (got[k], exp[k][1]) for k in got if got[k] != exp[k][1]}
    assert not bad


def test_prompt_text_equals_python_replace(payload_df):
    rows = D.labelled_corpus(payload_df).select("doc_id", "template_idx", "prompt").collect()
    for r in rows:
        tpl = C.CORPUS_TEMPLATES[r.template_idx][1]
        assert r.prompt == (tpl.replace("{data}", PAYLOADS[r.doc_id]) + C.CORPUS_SUFFIX_BEFORE + source_of(r.doc_id)
                            + C.CORPUS_SUFFIX_AFTER)


def test_junction_guard_rejects_unsafe_templates():
    assert D.junction_safe("Check '{data}' now")
    assert not D.junction_safe("Check {data} now")          # letters touch the payload
    assert not D.junction_safe("Check:'{data}'x")           # no white space around the fence
    assert not D.junction_safe("no placeholder")
    assert not D.junction_safe("two '{data}' and '{data}'")


def test_open_end_guard():
    assert D.open_end_safe("applies to the ")
    assert not D.open_end_safe("applies to the")            # no white space before the open end
    assert not D.open_end_safe("please do ")                # "do not" could run across
    assert not D.open_end_safe("compare ")                  # "compare and contrast"
    assert not D.open_end_safe("see source ")               # "source code"
    assert D.template_parts("Check '{data}' now")[0] == "split"
    assert D.template_parts("no placeholder")[0] == "fixed"
    assert D.template_parts("Check {data} now")[0] == "full"
    assert D._alternatives(r"(a|b.*)") is None              # not a plain alternation: never merged


def test_first_sample_and_audits(payload_df):
    c = D.labelled_corpus(payload_df)
    first = {r.tier_label: r.prompt_preview for r in D.first_sample_per_label(c).collect()}
    assert first[1] == (C.CORPUS_TEMPLATES[0][1].replace("{data}", PAYLOADS[0]) + C.CORPUS_SUFFIX_BEFORE + "src7"
                        + C.CORPUS_SUFFIX_AFTER)[:110]
    audit = D.shape_audit(c).collect()[0]
    assert (audit.rows, audit.null_cells) == (len(PAYLOADS) * 30, 0)
    assert {r.tier_label: r["count"] for r in D.label_distribution(c).collect()} == {
        1: len(PAYLOADS) * 10, 2: len(PAYLOADS) * 10, 3: len(PAYLOADS) * 10}
    means = D.feature_means(c).where(F.col("tier_label") == 1).collect()[0]
    assert means.context_provided == pytest.approx(0.9)


def test_sql_string_literal_round_trip(spark):
    texts = ["it's", "back\\slash \\n not a newline", "'{data}'", "%s {} \"q\"", "ΟΔΟΣ\t"]
    got = spark.range(1).select(*[F.expr(D._sql_string(t)).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    assert list(got) == texts
