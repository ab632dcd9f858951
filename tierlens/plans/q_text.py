"""Prompt and text-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx_
from ..operators import corpus as D
from ..operators import features as Fe
from ..operators import prompts as P
from ..tables import read
from . import oracle as O
from .registry import register

FEATS = "token_count, contains_analyze_compare, constraint_count, context_provided, output_format_complexity"


def corpus(spark, sf_dir):
    """D1 over whole documents: payload = full text, domain = source."""
    return D.labelled_corpus(read(spark, sf_dir, "documents", spread=True))


def _corpus_sql(body: str) -> str:
    return O.with_ctes(body, **O.corpus_ctes())


# --------------------------------------------------------------------------- prompts
PROMPTS_SQL = """
SELECT conv_id,
  CASE WHEN coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') = ''
       THEN arg_max(text, turn)
       ELSE string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user') END AS prompt
FROM conversations GROUP BY conv_id"""


@register("p1_p2_p4_prompts", O.with_ctes(
    f"SELECT conv_id, prompt, sha256({O.sql_strip('prompt')}) AS prompt_hash, {O.sql_task_type('prompt')} AS task_type "
    f"FROM prompts", prompts=PROMPTS_SQL))
def q_prompts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return P.with_prompt_facts(P.assemble_prompts(turns))


@register("p2_document_hash", f"SELECT doc_id, sha256({O.sql_strip('text')}) AS prompt_hash FROM documents")
def q_doc_hash(spark, sf_dir):
    from ..functions.text import prompt_hash
    return read(spark, sf_dir, "documents", spread=True).select("doc_id", prompt_hash("text").alias("prompt_hash"))


@register("p3_prompt_recurrence", O.with_ctes("""
SELECT prompt_hash, count(*) AS requests, min(timestamp) AS first_seen, count(DISTINCT routed_model) AS distinct_models
FROM request_logs GROUP BY prompt_hash""", **O.fx("request_logs")))
def q_recurrence(spark, sf_dir):
    return P.prompt_recurrence(fx_.request_logs(spark, sf_dir))


@register("p3_recurring_prompt_requests", O.with_ctes("""
SELECT id, prompt_hash, routed_model FROM request_logs
WHERE prompt_hash IN (SELECT prompt_hash FROM request_logs GROUP BY prompt_hash HAVING count(*) > 1)""",
                                                   **O.fx("request_logs")))
def q_recurring(spark, sf_dir):
    """P3 lookup / deduplication: requests whose prompt hash recurs (semi join on the
    hashes with more than one request)."""
    logs = fx_.request_logs(spark, sf_dir).select("id", "prompt_hash", "routed_model")
    hot = P.prompt_recurrence(logs.withColumn("timestamp", F.lit(None))).where(F.col("requests") > 1)
    return P.lookup_by_hash(logs, hot)


@register("p4_corpus_task_type", _corpus_sql(
    f"SELECT doc_id, template_idx, {O.sql_task_type('prompt')} AS task_type FROM corpus_raw"))
def q_corpus_task(spark, sf_dir):
    return D.corpus_task_types(read(spark, sf_dir, "documents", spread=True))


# --------------------------------------------------------------------------- features
@register("f12_routing_features_corpus", _corpus_sql(
    f"SELECT doc_id, template_idx, tier_label, {FEATS} FROM corpus"))
def q_f12(spark, sf_dir):
    return corpus(spark, sf_dir).drop("prompt")


@register("f13_diagnostic_features_corpus", _corpus_sql(
    f"SELECT doc_id, template_idx, {O.sql_diagnostic_features('prompt')} FROM corpus_raw"))
def q_f13_corpus(spark, sf_dir):
    return D.corpus_diagnostics(read(spark, sf_dir, "documents", spread=True))


@register("f13_diagnostic_features_documents",
          f"SELECT doc_id, {O.sql_diagnostic_features('text')} FROM documents")
def q_f13_docs(spark, sf_dir):
    return Fe.diagnostic_features(read(spark, sf_dir, "documents", spread=True), prompt="text", keep=["doc_id"])


@register("f12_online_features_prompts", O.with_ctes(
    f"SELECT conv_id, {O.sql_routing_features('prompt', 'TRUE', '2', '1')} FROM prompts", prompts=PROMPTS_SQL))
def q_f12_online(spark, sf_dir):
    prompts = P.assemble_prompts(read(spark, sf_dir, "conversations"))
    return Fe.online_routing_features(prompts, keep=["conv_id"])


# --------------------------------------------------------------------------- corpus audits
@register("d1_labelled_corpus", _corpus_sql(
    f"SELECT doc_id, template_idx, tier_label, sha256(prompt) AS prompt_sha256, length(prompt) AS prompt_chars, "
    f"{FEATS} FROM corpus"))
def q_d1(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", "template_idx", "tier_label", F.sha2("prompt", 256).alias("prompt_sha256"),
                    F.length("prompt").alias("prompt_chars"), *D.FEATURES)


@register("d2_shape_audit", _corpus_sql("""
SELECT count(*) AS rows,
  CAST(count_if(doc_id IS NULL) + count_if(template_idx IS NULL) + count_if(prompt IS NULL) + count_if(tier_label IS NULL)
     + count_if(token_count IS NULL) + count_if(contains_analyze_compare IS NULL) + count_if(constraint_count IS NULL)
     + count_if(context_provided IS NULL) + count_if(output_format_complexity IS NULL) AS BIGINT) AS null_cells
FROM corpus"""))
def q_d2(spark, sf_dir):
    return D.shape_audit(corpus(spark, sf_dir))


@register("d3_label_distribution", _corpus_sql(
    "SELECT tier_label, count(*) AS count FROM corpus GROUP BY tier_label ORDER BY tier_label"))
def q_d3(spark, sf_dir):
    return D.label_distribution(corpus(spark, sf_dir))


@register("d4_feature_means", _corpus_sql(
    "SELECT tier_label, " + ", ".join(f"avg({c}) AS {c}" for c in D.FEATURES) +
    " FROM corpus GROUP BY tier_label ORDER BY tier_label"))
def q_d4(spark, sf_dir):
    return D.feature_means(corpus(spark, sf_dir))


@register("d5_first_sample_per_tier", _corpus_sql(
    f"SELECT tier_label, substring(arg_min(prompt, template_idx * 1000000000000 + doc_id), 1, 110) AS prompt_preview, "
    + ", ".join(f"arg_min({c}, template_idx * 1000000000000 + doc_id) AS {c}" for c in D.FEATURES)
    + " FROM corpus GROUP BY tier_label"))
def q_d5(spark, sf_dir):
    return D.first_sample_per_label(corpus(spark, sf_dir))
