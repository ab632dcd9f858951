"""Exact duplicates by progressive refinement, in SQL functions only.

Two texts are equal when they are identical once every blank (space, \\t, \\n, \\v, \\f, \\r)
is deleted; a null text counts as empty, so null, empty and blank texts are one group.

1. Group by length.  One scan leaves a narrow table (length of the normalised text, hash
   of its first ``PREFIX`` characters).  Lengths that occur once are settled.
2. Group by prefix hash.  Only rows of repeated lengths are grouped by (length, prefix
   hash); pairs that occur once are settled.
3. Full hash.  A second scan reads the texts; SHA-256 of the whole normalised text is
   computed only where (length, prefix hash) survived.  Equal SHA-256 counts as equal.

What survives a step reaches the next one as a bit map: bit ``key mod 2^BITS``, 64 bits to
a row, so at most 2^BITS / 64 rows are broadcast whatever the input.  Keys that share a bit
only let a few rows through to a finer step, which then tells them apart.  No text is
shuffled; in :func:`dedup` those of surviving rows are, one per task and group at most.

Of a group, the row with the most code points in its original text stays, then the one with
the smallest id (nulls last); among rows equal in both, the least hash of the original text,
then one of the identical rows.  A row with a null or repeated id is a row like any other.
An empty table gives an empty result; other columns may have any name.

A group may hold any share of the rows: groups are aggregated in each task before they
move, and the at most ``HOT`` groups with over 1 / ``HOT`` of the rows are joined back by
broadcast, the others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, pick, position, positional, restore, stored

BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")
PREFIX = 64
BITS = 26


def normalised(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        t = F.replace(t, F.lit(blank), F.lit(""))
    return t


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(1 << BITS).cast("long"))


def _marks(keys: DataFrame) -> DataFrame:
    """The bit map of the one column of ``keys``: (word, mask)."""
    bit = _bit(F.col(keys.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return keys.select(F.shiftright(bit, 6).alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def _in_marks(df: DataFrame, key: Column, marks: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag: is the key's bit set?"""
    bit = _bit(key)
    met = df.withColumn(f"{name}_bit", bit).withColumn("word", F.shiftright(f"{name}_bit", 6)).join(F.broadcast(marks), "word", "left")
    flag = F.call_function("shiftright", F.col("mask"), (F.col(f"{name}_bit") % 64).cast("int")).bitwiseAND(1) == 1
    return met.withColumn(name, F.coalesce(flag, F.lit(False))).drop("word", "mask", f"{name}_bit")


def _keys(df: DataFrame, text: str) -> DataFrame:
    """With the normalised text, its length in bytes and its prefix hash."""
    return (df.withColumn("norm", normalised(F.col(text)))
            .withColumn("size", F.octet_length("norm").cast("long"))
            .withColumn("prefix", F.xxhash64("size", F.substring("norm", 1, PREFIX))))


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(key)


def _refined(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``norm`` and ``full``: the full hash of rows that length and prefix hash do
    not tell apart from all others, null elsewhere.  Uses the names norm, size, prefix, full,
    by_size, by_prefix."""
    narrow = stored(_keys(df, text).select("size", "prefix"), "exact-dedup-keys")
    sizes = _marks(_repeated(narrow, "size"))
    same_size = _in_marks(narrow, F.col("size"), sizes, "by_size").where("by_size")
    prefixes = _marks(_repeated(same_size, "prefix"))
    met = _in_marks(_in_marks(_keys(df, text), F.col("size"), sizes, "by_size"), F.col("prefix"), prefixes, "by_prefix")
    return (met.withColumn("full", F.when(F.col("by_size") & F.col("by_prefix"), F.unhex(F.sha2("norm", 256))))
            .drop("size", "prefix", "by_size", "by_prefix"))


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id (id of the row that stays), group_size,
    kept, and with ``digest`` text_sha256 of every normalised text."""
    met = _refined(pick(df, doc_id=doc_id, text=text), "text")
    more = [F.sha2("norm", 256).alias("text_sha256")] if digest else []
    rows = stored(met.select("doc_id", *more, "full", F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
                             F.when(F.col("full").isNotNull(), F.xxhash64("text")).alias("original"),
                             F.monotonically_increasing_id().alias("row")), "exact-dedup-rows")
    extra = ["text_sha256"] if digest else []
    alone = rows.where(F.col("full").isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                      F.lit(True).alias("kept"), *extra)
    alike = rows.where(F.col("full").isNotNull())
    order = F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "original", "row")
    groups = stored(alike.groupBy("full").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "exact-dedup-groups")
    both = join_groups(alike, groups, ["full"], "n")
    return alone.unionByName(both.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                                         (F.col("best.row") == F.col("row")).alias("kept"), *extra))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    flat = positional(df)
    cols, body, key = flat.columns, f"p{position(df, text)}", f"p{position(df, doc_id)}"
    met = _refined(flat, body).drop("norm")
    alone = met.where(F.col("full").isNull()).select(*cols)
    order = F.struct((-F.char_length(F.coalesce(body, F.lit("")))).alias("fewer"), F.col(key).isNull().alias("no_id"), F.col(key), F.xxhash64(body).alias("original"))
    best = met.where(F.col("full").isNotNull()).groupBy("full").agg(F.min_by(F.struct(*cols), order).alias("best"))
    return restore(alone.unionByName(best.select("best.*")), df)
