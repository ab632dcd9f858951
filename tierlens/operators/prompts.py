"""Prompt preparation (P1-P4): assembly from chat turns, hashing, recurrence, task type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXTRACTION_TERMS, SUMMARIZATION_TERMS
from ..functions.text import col_of, contains_any, prompt_hash

# Turns per first-level chunk.  A conversation longer than this is concatenated in
# parallel pieces first, so one huge conversation never becomes one giant list.
TURNS_PER_CHUNK = 1024


def assemble_prompts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text",
                     turns_per_chunk: int = TURNS_PER_CHUNK) -> DataFrame:
    """User contents in turn order joined by one space; if that is empty, the
    content of the last message of any role.  Output: (conv_id, prompt).

    Two aggregation levels: (conversation, turn chunk) builds partial strings with
    map-side partial aggregation; (conversation) then joins the few partial strings.
    """
    is_user = F.col(role) == "user"
    lvl1 = (turns.select(conv, turn, text, is_user.alias("u"),
                         F.floor(F.col(turn) / turns_per_chunk).alias("chunk"))
            .groupBy(conv, "chunk")
            .agg(F.array_sort(F.collect_list(F.when(F.col("u"), F.struct(F.col(turn).alias("t"),
                                                                         F.col(text).alias("x"))))).alias("us"),
                 F.max_by(text, turn).alias("last_text"),
                 F.max(turn).alias("last_turn"))
            .select(conv, "chunk", "last_text", "last_turn",
                    F.when(F.size("us") > 0,
                           F.array_join(F.transform("us", lambda s: s["x"]), " ")).alias("part")))
    lvl2 = (lvl1.groupBy(conv)
            .agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(),
                                                    F.struct("chunk", "part")))).alias("ps"),
                 F.max_by("last_text", "last_turn").alias("last_text")))
    joined = F.array_join(F.transform("ps", lambda s: s["part"]), " ")
    return lvl2.select(conv, F.when(joined == "", F.col("last_text")).otherwise(joined).alias("prompt"))


def task_type_col(prompt: Column | str) -> Column:
    """Summarization / extraction / classification by substring keywords."""
    lower = F.lower(col_of(prompt))
    return (F.when(contains_any(lower, SUMMARIZATION_TERMS), F.lit("summarization"))
             .when(contains_any(lower, EXTRACTION_TERMS), F.lit("extraction"))
             .otherwise(F.lit("classification")))


def with_prompt_facts(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """P2 + P4 columns next to the prompt."""
    return df.select("*", prompt_hash(prompt).alias("prompt_hash"),
                     task_type_col(prompt).alias("task_type"))


def prompt_recurrence(logs: DataFrame) -> DataFrame:
    """Requests per prompt hash, first sighting, distinct models that served it.

    ``count``/``min`` aggregate partially on the map side; the distinct count is
    planned by Spark as a two-level aggregation on (hash, model), so a hash that
    recurs in a third of all rows is still spread over many tasks.
    """
    return (logs.groupBy("prompt_hash")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.min("timestamp").alias("first_seen"),
                 F.countDistinct("routed_model").alias("distinct_models")))


def lookup_by_hash(logs: DataFrame, hashes: DataFrame) -> DataFrame:
    """P3 lookup: log rows whose prompt hash is in ``hashes`` (semi join, no duplicates)."""
    return logs.join(hashes.select("prompt_hash").distinct(), "prompt_hash", "left_semi")
