"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (leftmost, non-overlapping per kind; code points, end exclusive): ``assign``
(a secret's name, a sign, a value of 8 or more characters), ``access`` (AKIA
identifiers of 16 or more), ``hex`` (32 or more hex digits).

Weak parts say little alone: ``ident`` (other key identifiers, client and account
names), ``key`` (40 mixed characters without a name), ``endpoint`` (service addresses).
They are joined as intervals: parts whose ranges, widened by ``SCOPE`` characters, meet
inside one text co-occur.  A weak part is reported only when a complementary part does:
identifier with secret, endpoint with either (base spans count as their roles too).
The join runs on (text, bin of ``SCOPE`` characters), so a long text is spread over its
bins and a bin holds a bounded number of parts.

A null text is empty and has no spans.  Repeated rows (same id and text) get the same
spans each; rows that share an id but not the text are kept apart by the text's hash;
an empty table gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, position, positional, restore, stored

SCOPE = 256
#: kind -> (role, pattern, group whose length counts, least length); in order of report.
KINDS = {
    "assign": ("secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("ident", r"AKIA[A-Z0-9]+", 0, 16),
    "hex": ("secret", r"[0-9a-f]{32,}", 0, 32),
    "ident": ("ident", r"(?<![A-Za-z0-9_])(?:(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:client_?id|account_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.-]{6,})", 0, 1),
    "key": ("secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40),
    "endpoint": ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 1),
}
BASE = ("assign", "access", "hex")
WEAK = ("ident", "key", "endpoint")


def _may_have(text, low) -> dict:
    """A cheap test per kind that every match passes."""
    has = lambda c, *xs: F.greatest(*[F.contains(c, F.lit(x)) for x in xs], F.lit(False))
    return {"assign": has(low, "password", "passwd", "secret", "token", "apikey", "api_key"),
            "access": has(text, "AKIA"), "hex": text.rlike("[0-9a-f]{32}"),
            "ident": has(text, "ASIA", "AROA", "AIDA") | has(low, "clientid", "client_id", "accountid", "account_id", "accesskey", "access_key"),
            "key": text.rlike("[A-Za-z0-9+/]{40}"), "endpoint": has(text, "://")}


def _scan(rows: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, key, found): per kind the lengths that give the places."""
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "low": F.lower(F.coalesce("text", F.lit("")))})
    may = _may_have(F.col("text"), F.col("low"))

    def lengths(kind):
        _, pattern, group, least = KINDS[kind]
        size = lambda xs: F.transform(xs, lambda x: F.length(x))
        all_of = lambda g: size(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)))
        found = F.struct(F.lit(kind).alias("kind"), size(F.split("text", pattern, -1)).alias("gap"), all_of(0).alias("len"),
                         F.transform(all_of(group), lambda n: n >= least).alias("ok"))
        return F.when(may[kind], found)

    found = F.filter(F.array(*[lengths(k) for k in KINDS]), lambda x: x.isNotNull() & (F.size(x["len"]) > 0))
    return rows.select("doc_id", F.xxhash64("text", F.length("text")).alias("key"), found.alias("found"))


def _parts(scanned: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end) of all candidates; a repeated row counts once."""
    hit = scanned.where(F.size("found") > 0).dropDuplicates(["doc_id", "key"])
    one = hit.select("doc_id", "key", F.explode("found").alias("f"))
    one = one.select("doc_id", "key", "f.kind", F.posexplode(F.arrays_zip("f.gap", "f.len", "f.ok")).alias("k", "x"))
    upto = Window.partitionBy("doc_id", "key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.col("x.len"), F.lit(0))
    one = one.withColumn("end", F.sum(F.col("x.gap") + size).over(upto))
    return one.where(F.col("x.ok")).select("doc_id", "key", "kind", (F.col("end") - size).alias("start"), "end")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts with a complementary part in scope: an interval join by bins."""
    role = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])
    p = parts.withColumn("role", role[F.col("kind")])
    first, last = F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE)
    left = p.where(F.col("kind").isin(*WEAK)).withColumn("bin", F.explode(F.sequence(first - 1, last + 1)))
    right = p.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"),
                     F.col("role").alias("r"), F.explode(F.sequence(first, last)).alias("b"))
    fits = ((left["doc_id"].eqNullSafe(right["d"])) & (left["key"] == right["k"]) & (left["bin"] == right["b"])
            & (left["role"] != right["r"]) & (right["s"] < left["end"] + SCOPE) & (right["e"] > left["start"] - SCOPE))
    return left.join(right, fits, "left_semi").select("doc_id", "key", "kind", "start", "end").distinct()


def _spans(scanned: DataFrame) -> DataFrame:
    """(doc_id, key, s): the spans of each distinct text in order, with the end before."""
    parts = stored(_parts(scanned), "parts")
    spans = parts.where(F.col("kind").isin(*BASE)).unionByName(_linked(parts))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    before = Window.partitionBy("doc_id", "key").orderBy("start", "o", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("o", order[F.col("kind")]).withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "o", "end", "kind", "done"))).alias("s"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans: array of (kind, start, end) in order."""
    scanned = stored(_scan(pick(docs, doc_id=id_col, text=text_col)), "secrets")
    found = _spans(scanned).withColumnsRenamed({"doc_id": "d", "key": "k"})
    both = scanned.join(found, scanned["doc_id"].eqNullSafe(found["d"]) & (scanned["key"] == found["k"]), "left")
    spans = F.transform("s", lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return both.select("doc_id", F.coalesce(spans, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans by one."""
    flat = positional(docs)
    own, at = f"p{position(docs, id_col)}", f"p{position(docs, text_col)}"
    found = _spans(_scan(pick(docs, doc_id=id_col, text=text_col))).withColumnsRenamed({"doc_id": "d", "key": "k"})
    key = F.xxhash64(F.coalesce(F.col(at), F.lit("")), F.length(F.coalesce(F.col(at), F.lit(""))))
    both = flat.withColumn("key", key)
    both = both.join(found, both[own].eqNullSafe(found["d"]) & (both["key"] == found["k"]), "left")
    pieces = F.transform("s", lambda x: F.concat(
        F.substr(F.col(at), (x["done"] + 1).cast("int"), F.greatest(x["start"] - x["done"], F.lit(0)).cast("int")),
        F.when((x["start"] >= x["done"]), F.lit(mark)).otherwise(F.lit(""))))
    tail = F.substr(F.col(at), (F.array_max(F.transform("s", lambda x: x["end"])) + 1).cast("int"))
    return restore(both.withColumn(at, F.when(F.col("s").isNull(), F.col(at)).otherwise(F.concat(F.array_join(pieces, ""), tail))), docs)
