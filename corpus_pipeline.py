"""A training corpus from ``documents``: known languages, one text of each group of near
copies, no benchmark passages, no secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``.  ``run`` writes each stage's rows below the shared folder and
reads them again, so a stage starts from a table and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.llm import bpe, decontaminate, jaccard, langid, secrets
from tierlens.llm.common import stored, table
from tierlens.llm.queries import held_out, vocabulary

#: A text whose best language gets less than this is rejected, as is one without letters.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts in a learned language."""
    return langid.keep_known(docs, langid.fit(docs.where(~held_out())), MIN_SCORE)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no benchmark item contaminates."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; reported secrets are replaced in its text."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and a digest of what they decode to."""
    both = bpe.round_trip(docs, vocabulary("word_bpe_49k.json"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("bpe_encoding", bpe_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained network, which SQL cannot state.
ORACLE_SQL = None
