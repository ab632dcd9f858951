"""Labelled corpus (D1) and its audits.

D1 expands every payload row through the 30 fixed templates with ``explode`` (a
per-row generator: no cross join and no shuffle).

The expansion repeats each payload 30 times, so features are not computed on the
30 expanded prompts.  A prompt is ``head + payload + fixed + domain + suffix``.
The payload, and ``domain + suffix``, are summarised once per payload row, before
the expansion; the constant parts are summarised once per template, in a 30-row
template frame that is broadcast (its size is set by the constants) and joined by
template index.  The expanded rows only merge these summaries
(``functions.textstats``).  The merge is exact when no keyword or regex match can
contain the junction characters and lower-casing cannot change across the
junction: each template is checked for that at plan time, and a template that
fails the check is featurised on its full prompt.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.textstats import Spec, View, group_spec, grouped, merge, summary
from .features import (ALL_SPEC, F12_GROUPS, F12_SPEC, F13_SPEC, TASK_SPEC, diagnostic_features_from, routing_features_from,
                       task_type_from)
from .selection import MAX_CLASSES

FEATURES = C.FEATURE_COLUMNS
_JUNCTION_CHARS = "'\""


def _split_template(text: str):
    """(head, tail) around the single placeholder, or None."""
    if text.count(C.CORPUS_PLACEHOLDER) != 1:
        return None
    head, tail = text.split(C.CORPUS_PLACEHOLDER)
    return head, tail


def junction_safe(text: str) -> bool:
    """True when features of head + payload + tail equal the merge of the three parts'.

    The payload is fenced by a quote on both sides, preceded by white space and
    followed by white space or ``.``/``,`` + white space: no keyword, marker or regex
    alternative contains a quote, so no match crosses a junction; and those
    neighbours stop Unicode case-mapping context (final sigma) at the junction.
    """
    parts = _split_template(text)
    if parts is None:
        return False
    head, tail = parts
    q = head[-1:] if head else ""
    if q not in _JUNCTION_CHARS or q in ALL_SPEC.chars():
        return False
    if len(head) < 2 or not head[-2].isspace():
        return False
    tail_full = tail + C.CORPUS_SUFFIX_BEFORE
    if not tail_full.startswith(q) or len(tail_full) < 3:
        return False
    return tail_full[1].isspace() or (tail_full[1] in ".," and tail_full[2].isspace())


def _alternatives(pattern: str):
    """Literal alternatives of a constraint regex and whether it has the digit-dot
    alternative; None when the pattern is not such a plain alternation."""
    body = re.sub(r"^\(\?=\[[^\]]*\]\)", "", pattern)
    if not (body.startswith("(") and body.endswith(")")):
        return None
    literals, digit_dot = [], False
    for alt in body[1:-1].split("|"):
        if alt in (r"\p{Nd}\.", r"\d\."):
            digit_dot = True
        elif re.fullmatch(r"[a-z :;]+", alt):
            literals.append(alt)
        else:
            return None
    return literals, digit_dot


def open_end_safe(fixed: str, spec: Spec = ALL_SPEC) -> bool:
    """True when, for every text s, features of ``fixed + s`` equal the merge of the
    two parts' summaries.

    ``fixed`` must end in white space (which stops case-mapping context), and no
    keyword, marker or regex literal may start inside ``fixed`` and run past its end.
    """
    if not fixed or not fixed[-1].isspace():
        return False
    lower = fixed.lower()
    pieces = [(k, lower) for k in spec.keywords] + [(m, fixed) for m in spec.markers]
    for r in spec.regexes:
        alts = _alternatives(r)
        if alts is None:
            return False
        pieces += [(a, lower) for a in alts[0]]
    return not any(side.endswith(k[:i]) for k, side in pieces for i in range(1, len(k)))


def template_parts(text: str):
    """(mode, head, fixed) of a template.

    split: ``head + payload + fixed + domain + suffix``; fixed: no payload, the prompt
    is ``fixed + domain + suffix``; full: featurised on the whole prompt per row.
    """
    parts = _split_template(text)
    if parts is not None and junction_safe(text) and open_end_safe(parts[1] + C.CORPUS_SUFFIX_BEFORE):
        return "split", parts[0], parts[1] + C.CORPUS_SUFFIX_BEFORE
    if C.CORPUS_PLACEHOLDER not in text and open_end_safe(text + C.CORPUS_SUFFIX_BEFORE):
        return "fixed", "", text + C.CORPUS_SUFFIX_BEFORE
    return "full", "", ""


def _sql_string(text: str) -> str:
    """A Spark SQL string literal holding ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _template_array():
    """The 30 templates as a literal array of structs (one SQL expression, so it
    is built with a single call into the JVM)."""
    rows = []
    for i, (tier, text, ctx, base_c, base_f) in enumerate(C.CORPUS_TEMPLATES):
        rows.append(f"named_struct('template_idx', {int(i)}, 'tier_label', {int(tier)}, "
                    f"'template', {_sql_string(text)}, 'context_provided', {str(bool(ctx)).lower()}, "
                    f"'base_constraints', {int(base_c)}, 'base_format', {int(base_f)})")
    return F.expr("array(" + ", ".join(rows) + ")")


def template_frame(spark, spec: Spec, groups: tuple = ()) -> DataFrame:
    """One row per fixed template, with the summaries of its constant parts.

    A local relation of ``len(CORPUS_TEMPLATES)`` rows: its size is set by the
    constants, not by the data, so it is safe to broadcast.  The summaries are
    computed once, over these 30 rows, instead of once per expanded prompt.
    """
    rows = []
    for i, (tier, text, ctx, base_c, base_f) in enumerate(C.CORPUS_TEMPLATES):
        mode, head, fixed = template_parts(text)
        rows.append((i, tier, text, bool(ctx), base_c, base_f, mode == "split", mode == "full", head, fixed))
    df = spark.createDataFrame(rows, "template_idx int, tier_label int, template string, context_provided boolean, "
                                     "base_constraints int, base_format int, payload boolean, full boolean, "
                                     "head string, fixed string")
    parts = df.select("*", summary("head", spec).alias("h"), summary("fixed", spec).alias("x"))
    return parts.select("template_idx", "tier_label", "template", "context_provided", "base_constraints",
                        "base_format", "payload", "full", *[_grouped(c, spec, groups).alias(c) for c in ("h", "x")])


def _grouped(s: str, spec: Spec, groups: tuple) -> Column:
    return grouped(s, spec, groups) if groups else F.col(s)


def _prompt(template: Column, payload: Column, domain: Column) -> Column:
    return F.concat(F.replace(template, F.lit(C.CORPUS_PLACEHOLDER), payload),
                    F.lit(C.CORPUS_SUFFIX_BEFORE), domain, F.lit(C.CORPUS_SUFFIX_AFTER))


def expand_templates(payloads: DataFrame, key: str = "doc_id", payload: str = "text",
                     domain: str = "source") -> DataFrame:
    """D1 prompts: template with ``{data}`` replaced by the payload, plus the domain
    suffix.  Columns: key, template_idx, tier_label, prompt, context_provided,
    base_constraints, base_format."""
    t = payloads.select(key, payload, domain, F.explode(_template_array()).alias("t"))
    return t.select(key, F.col("t.template_idx").alias("template_idx"),
                    F.col("t.tier_label").alias("tier_label"),
                    _prompt(F.col("t.template"), F.col(payload), F.col(domain)).alias("prompt"),
                    F.col("t.context_provided").alias("context_provided"),
                    F.col("t.base_constraints").alias("base_constraints"),
                    F.col("t.base_format").alias("base_format"))


def corpus_summaries(payloads: DataFrame, spec: Spec, key: str = "doc_id", payload: str = "text",
                     domain: str = "source", groups: tuple = ()) -> DataFrame:
    """Expanded corpus rows with the prompt and its summary ``_s`` under ``spec``, or under its
    ``group_spec`` where ``groups`` of keywords are given.

    Below the generator, once per payload row: the payload summary ``_d`` and the
    summary ``_y`` of ``domain + suffix``.  The template parts are planning-time
    literals, so the per-row work after the expansion is merges of small structs
    (and the whole-prompt summary for a template that fails the junction checks).
    """
    p = payloads.select(key, payload, domain, F.concat(F.col(domain), F.lit(C.CORPUS_SUFFIX_AFTER)).alias("_ys"))
    p = p.select(key, payload, domain, summary(f"`{payload}`", spec).alias("_d"), summary("_ys", spec).alias("_y"))
    p = p.select(key, payload, domain, *[_grouped(c, spec, groups).alias(c) for c in ("_d", "_y")])
    n, whole = len(C.CORPUS_TEMPLATES), spec
    frame, spec = template_frame(payloads.sparkSession, spec, groups), group_spec(spec, groups) if groups else spec
    p = p.select(key, payload, domain, "_d", "_y",
                 F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("template_idx"))
    t = p.join(F.broadcast(frame), "template_idx").select(
        key, payload, domain, "_d", "_y", F.struct(*[F.col(c) for c in (
            "template", "template_idx", "tier_label", "context_provided", "base_constraints", "base_format",
            "payload", "full", "h", "x")]).alias("t"))
    # one projection per level: each merge is a column, read by reference.
    # The prompt text itself is only built where it is used (output, whole-prompt templates).
    t = t.select(key, payload, domain, F.col("t.template").alias("_tpl"),
                 F.col("t.template_idx").alias("template_idx"), F.col("t.tier_label").alias("tier_label"),
                 F.col("t.context_provided").alias("context_provided"),
                 F.col("t.base_constraints").alias("base_constraints"), F.col("t.base_format").alias("base_format"),
                 F.col("t.full").alias("_full"), "_y",
                 F.when(F.col("t.payload"), merge("t.h", "_d", spec)).otherwise(F.col("t.h"))
                 .alias("_hd"), F.col("t.x").alias("_x"))
    t = t.select("*", merge("_hd", "_x", spec).alias("_hx"))
    t = t.select("*", merge("_hx", "_y", spec).alias("_m"))
    prompt = _prompt(F.col("_tpl"), F.col(payload), F.col(domain))
    if any(template_parts(text)[0] == "full" for _, text, *_ in C.CORPUS_TEMPLATES):
        t = t.select("*", F.when(F.col("_full"), summary(prompt, whole)).alias("_p"))
        s = F.when(F.col("_full"), _grouped("_p", whole, groups)).otherwise(F.col("_m"))
    else:
        s = F.col("_m")
    return t.select(key, "template_idx", "tier_label", prompt.alias("prompt"), "context_provided",
                    "base_constraints", "base_format", s.alias("_s"))


def labelled_corpus(payloads: DataFrame, key: str = "doc_id", payload: str = "text",
                    domain: str = "source") -> DataFrame:
    """(key, template_idx, prompt, tier_label, five F12 features)."""
    c = corpus_summaries(payloads, F12_SPEC, key, payload, domain, F12_GROUPS)
    v = View(F.col("_s"), group_spec(F12_SPEC, F12_GROUPS))
    return c.select(key, "template_idx", "prompt", "tier_label",
                    *routing_features_from(v, F.col("context_provided"), F.col("base_constraints"),
                                           F.col("base_format")))


def corpus_diagnostics(payloads: DataFrame, key: str = "doc_id") -> DataFrame:
    """F13 over the expanded corpus."""
    c = corpus_summaries(payloads, F13_SPEC, key)
    return c.select(key, "template_idx", *diagnostic_features_from(View(F.col("_s"), F13_SPEC)))


def corpus_task_types(payloads: DataFrame, key: str = "doc_id") -> DataFrame:
    """P4 over the expanded corpus."""
    c = corpus_summaries(payloads, TASK_SPEC, key)
    return c.select(key, "template_idx", task_type_from(View(F.col("_s"), TASK_SPEC)).alias("task_type"))


def shape_audit(corpus: DataFrame) -> DataFrame:
    """Row count and total NULL cells over all columns."""
    nulls = F.lit(0)
    for c in corpus.columns:
        nulls = nulls + F.count_if(F.col(c).isNull())
    return corpus.agg(F.count(F.lit(1)).alias("rows"), nulls.cast("long").alias("null_cells"))


def label_distribution(corpus: DataFrame, label: str = "tier_label") -> DataFrame:
    """D3: rows per label, ordered by label."""
    return corpus.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(label)


def feature_means(corpus: DataFrame, label: str = "tier_label") -> DataFrame:
    """Mean of every numeric feature per label."""
    return (corpus.groupBy(label).agg(*[F.avg(c).alias(c) for c in FEATURES]).orderBy(label))


PREVIEW_CHARS = 110


def first_sample_per_label(corpus: DataFrame, label: str = "tier_label", order: tuple = ("template_idx", "doc_id")) -> DataFrame:
    """First row of each label in generation order (NULL first), prompt cut to 110 chars.

    The least key of each label is found first, over the keys alone: minima of plain columns
    are kept in a hash map per (label, leading keys), so no row is sorted or spilled.  Then only
    the rows at these keys get a prompt and features: as literals (up to ``MAX_CLASSES`` labels)
    the keys are compared in the scan where they are columns of the table.  ``min_by`` picks one of
    the rows that share a key.
    """
    *lead, last = order
    least = corpus.groupBy(label, *lead).agg(F.min(last).alias("_least"), F.count_if(F.col(last).isNull()).alias("_nulls"))
    key = F.struct(*lead, F.when(F.col("_nulls") == 0, F.col("_least")).alias(last))
    first = least.groupBy(label).agg(F.min(key).alias("k")).select(F.col(label).alias("_label"), *[F.col(f"k.{c}").alias(f"_{c}") for c in order])
    found = first.limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        same = F.col(label).eqNullSafe(F.col("_label"))
        for c in order:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = corpus.join(first, same, "left_semi")
    else:
        rows = corpus.where(_equals_any(corpus, (label, *order), found))
        for i, c in enumerate(order, 1):
            rows = rows.where(_equals_any(corpus, (c,), list(dict.fromkeys((r[i],) for r in found))))
    key = F.struct(*[F.col(c) for c in order])
    row = F.struct(F.substring("prompt", 1, PREVIEW_CHARS).alias("prompt_preview"), *[F.col(c) for c in FEATURES])
    return (rows.groupBy(label).agg(F.min_by(row, key).alias("r"))
            .select(label, "r.*"))


def _equals_any(df: DataFrame, columns: tuple, values: list) -> Column:
    """True where ``columns`` equal one of the tuples ``values`` (NULL equals NULL), else false or NULL."""
    out = F.lit(False)
    for v in values:
        one = F.lit(True)
        for c, x in zip(columns, v):
            one = one & (F.col(c).isNull() if x is None else F.col(c) == F.lit(x).cast(df.schema[c].dataType))
        out = out | one
    return out
