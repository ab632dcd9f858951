"""Text features (F1-F13) and task type inputs, read from mergeable text summaries.

Every feature is a built-in expression: substring tests, non-overlapping regex
counts and a word count.  The summary of a prompt is computed once per row and all
features read from it, so the lower-cased text is scanned once per keyword and
once per regex, with no Python in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import col_of
from ..functions.textstats import Spec, View, summary


def unicode_digits(pattern: str) -> str:
    """Python's ``\\d`` on text is any Unicode decimal digit."""
    return pattern.replace(r"\d", r"\p{Nd}")


def _fast(pattern: str, first_chars: str) -> str:
    """Same matches, with a look-ahead that skips positions no alternative can start at."""
    return f"(?=[{first_chars}])" + pattern


ROUTING_RE = _fast(unicode_digits(C.ROUTING_CONSTRAINT_RE), r"\p{Nd}msdnabeo")
DIAGNOSTIC_RE = _fast(unicode_digits(C.DIAGNOSTIC_CONSTRAINT_RE), r"\p{Nd}msdnaf")

F12_SPEC = Spec(keywords=tuple(C.ANALYZE_COMPARE_TERMS + C.FORMAT_LEVEL3_TERMS + C.FORMAT_LEVEL2_TERMS),
                regexes=(ROUTING_RE,))
#: What F12 asks of its keywords: whether any of a group is there.
F12_GROUPS = (tuple(C.ANALYZE_COMPARE_TERMS), tuple(C.FORMAT_LEVEL3_TERMS), tuple(C.FORMAT_LEVEL2_TERMS))
F13_SPEC = Spec(keywords=tuple(C.TIER1_KEYWORDS + C.TIER2_KEYWORDS + C.TIER3_KEYWORDS),
                markers=tuple(C.CODE_SYNTAX_MARKERS), regexes=(DIAGNOSTIC_RE,))
TASK_SPEC = Spec(keywords=tuple(C.SUMMARIZATION_TERMS + C.EXTRACTION_TERMS), words=False)
ALL_SPEC = F12_SPEC.union(F13_SPEC).union(TASK_SPEC)


def tokens_from(v: View) -> Column:                                              # F1
    return F.floor(v.words().cast("double") * F.lit(C.TOKEN_MULTIPLIER)).cast("int")


def routing_features_from(v: View, context_provided: Column, base_constraints: Column,
                          base_format: Column) -> list[Column]:
    """F12 (F1-F5) in model column order."""
    b = base_format.cast("int")
    fmt = (F.when(v.any_of(C.FORMAT_LEVEL3_TERMS), F.greatest(b, F.lit(3)))
            .when(v.any_of(C.FORMAT_LEVEL2_TERMS), F.greatest(b, F.lit(2)))
            .otherwise(b))
    return [tokens_from(v).alias("token_count"),
            v.any_of(C.ANALYZE_COMPARE_TERMS).cast("int").alias("contains_analyze_compare"),
            (base_constraints.cast("int") + v.count(ROUTING_RE)).cast("int").alias("constraint_count"),
            context_provided.cast("boolean").cast("int").alias("context_provided"),
            fmt.cast("int").alias("output_format_complexity")]


def diagnostic_features_from(v: View) -> list[Column]:
    """F1, F6-F11."""
    tokens = tokens_from(v)
    return [tokens.alias("token_count"),
            v.n_present(C.TIER1_KEYWORDS).alias("tier1_keyword_density"),
            v.n_present(C.TIER2_KEYWORDS).alias("tier2_keyword_density"),
            v.n_present(C.TIER3_KEYWORDS).alias("tier3_keyword_density"),
            v.count(DIAGNOSTIC_RE).cast("int").alias("constraint_count"),
            v.any_marker(C.CODE_SYNTAX_MARKERS).cast("double").alias("contains_code_syntax"),
            (tokens > C.LONG_CONTEXT_TOKENS).cast("double").alias("is_long_context")]


def task_type_from(v: View) -> Column:
    """First matching keyword list wins."""
    return (F.when(v.any_of(C.SUMMARIZATION_TERMS), F.lit("summarization"))
             .when(v.any_of(C.EXTRACTION_TERMS), F.lit("extraction"))
             .otherwise(F.lit("classification")))


# --------------------------------------------------------------------------- per-prompt API
def _staged(df: DataFrame, prompt: Column, spec: Spec) -> DataFrame:
    """Summary in its own projection (an expensive struct read many times is not
    inlined by the optimizer, so each text is scanned once)."""
    return df.select("*", prompt.alias("_txt")).select("*", summary("_txt", spec).alias("_s")).drop("_txt")


def routing_features(df: DataFrame, prompt: str = "prompt", context_provided: str | Column = "context_provided",
                     base_constraints: str | Column = "base_constraints",
                     base_format: str | Column = "base_format", keep: list[str] | None = None) -> DataFrame:
    """F12 as a select; ``keep`` are pass-through columns placed first."""
    st = _staged(df, col_of(prompt), F12_SPEC)
    v = View(F.col("_s"), F12_SPEC)
    return st.select(*(keep or []), *routing_features_from(v, col_of(context_provided), col_of(base_constraints),
                                                           col_of(base_format)))


def online_routing_features(df: DataFrame, prompt: str = "prompt", keep: list[str] | None = None) -> DataFrame:
    """F12 with the fixed online / failure defaults."""
    return routing_features(df, prompt, F.lit(C.ONLINE_CONTEXT_PROVIDED), F.lit(C.ONLINE_BASE_CONSTRAINTS),
                            F.lit(C.ONLINE_BASE_FORMAT), keep)


def diagnostic_features(df: DataFrame, prompt: str = "prompt", keep: list[str] | None = None) -> DataFrame:
    """F13 as a select."""
    st = _staged(df, col_of(prompt), F13_SPEC)
    return st.select(*(keep or []), *diagnostic_features_from(View(F.col("_s"), F13_SPEC)))


def routing_feature_cols(prompt: Column | str, context_provided: Column, base_constraints: Column,
                         base_format: Column) -> list[Column]:
    """F12 as column expressions (for use inside another select)."""
    return routing_features_from(View(summary(col_of(prompt), F12_SPEC), F12_SPEC), context_provided,
                                 base_constraints, base_format)


def diagnostic_feature_cols(prompt: Column | str) -> list[Column]:
    return diagnostic_features_from(View(summary(col_of(prompt), F13_SPEC), F13_SPEC))

