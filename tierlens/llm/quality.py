"""Quality rules with a divergence test, in DataFrame functions only.

Base counts per text (words are runs of characters other than blank and U+0009-U+000D):
words, their code points, symbols, lines equal to an earlier line, and words inside
five-word windows that occur at least twice in the text.  A text fails the base rules
with fewer than ``MIN_WORDS`` words or more than a fifth of its words repeated.

Divergence: every text has a histogram over six character classes and one over common
words (``COMMON`` and a bin for all others).  The references are the sums of these
histograms over all rows of a language.  A text is compared with its own language's
reference, or with the nearest one when it has no language or an unknown one, by the
Jensen-Shannon distance (base 2, 0 to 1); it is dropped when either distance passes its
limit.  Guards: texts under ``GUARD_WORDS`` words and references of under
``REF_WORDS`` words are not judged.

A null text counts as empty (and fails the base rules).  Repeated rows count twice in
the references and are judged alike; an empty table gives an empty result; other
columns are ignored.  Every language with enough words has a reference (over ``MAX_LANGS`` are an error);
a text of any further language goes to its nearest reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

MIN_WORDS = 10
GUARD_WORDS = 50
REF_WORDS = 1000
CHAR_LIMIT = 0.285
WORD_LIMIT = 0.45
MAX_LANGS = 1000
WINDOW = 5
#: Frequent function words of the languages (en, fr, de, es).
COMMON = sorted({
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on",
    "de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "pour",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf",
    "el", "y", "los", "las", "se", "del", "por", "con"})
SPACES = " \t\n\x0b\x0c\r"
#: Character classes beside blanks and the rest: upper case, digits, ASCII marks, beyond ASCII.
CLASSES = ("A-Z", "0-9", r"!-/:-@\[-`{-~", r"\x{80}-\x{10FFFF}")


def _left(text, others: str):
    """Number of characters that are not in the class."""
    return F.length(F.regexp_replace(text, f"[{others}]+", "")).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common)."""
    t = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("text", F.coalesce("text", F.lit("")))
    bare = F.btrim("text", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = [_left(F.col("text"), "^" + c).alias(f"c{i}") for i, c in enumerate(CLASSES)]
    t = t.select("doc_id", "lang", words.alias("w"), lines.alias("lines"), F.length("text").cast("long").alias("len"),
                 _left(F.col("text"), "^#*$%&|<>").alias("n_symbols"), *counts)
    at = lambda i: F.get("w", i)
    windows = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)])))
    t = t.select("doc_id", "lang", "len", "n_symbols", *[f"c{i}" for i in range(len(CLASSES))],
                 F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.filter("w", lambda x: F.lower(x).isin(COMMON)).alias("cw"), windows.alias("h"))
    # only texts in which some window occurs twice are sorted
    twice = F.size(F.array_distinct("h")) < F.size("h")
    t = t.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    t = t.withColumn("cw", F.transform("cw", lambda x: F.lower(x)))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    cover = F.aggregate(again, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
                        lambda s: s["n"])
    spaces = F.col("len") - F.col("word_chars")
    marked = sum((F.col(f"c{i}") for i in range(len(CLASSES))), spaces)
    common = [F.size("cw") - F.size(F.array_remove("cw", c)) for c in COMMON]
    return t.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
                    F.array(spaces, *[f"c{i}" for i in range(len(CLASSES))], F.col("len") - marked).alias("chars"),
                    F.array(*[c.cast("long") for c in common], F.col("n_words") - F.size("cw")).alias("common"))


def references(feats: DataFrame) -> list[dict]:
    """Histogram sums of every language with enough words: a few numbers each."""
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("chars", len(CLASSES) + 2), ("common", len(COMMON) + 1)) for i in range(n)]
    rows = (feats.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums)
            .where(F.col("n") >= REF_WORDS).limit(MAX_LANGS + 1).collect())
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows.sort(key=lambda r: (-r["n"], r["lang"]))
    return [{"lang": r["lang"], "chars": [r[f"chars{i}"] for i in range(len(CLASSES) + 2)],
             "common": [r[f"common{i}"] for i in range(len(COMMON) + 1)]} for r in rows]


def _shares(counts):
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1).cast("long")))


def js_distance(p, q):
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, **cols) -> DataFrame:
    """The counts with base_failed, js_chars, js_words (null where not judged) and kept."""
    f = stored(features(docs, **cols), "quality")
    refs = references(f)
    f = f.withColumns({"p": _shares("chars"), "q": _shares("common")})
    if refs:
        share = lambda xs: F.array(*[F.lit(x / max(1, sum(xs))) for x in xs])
        known = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), share(r["chars"]).alias("p"), share(r["common"]).alias("q")) for r in refs])
        own = F.filter(known, lambda r: r["lang"].eqNullSafe(F.col("lang")))
        f = f.withColumn("refs", F.when(F.col("n_words") >= GUARD_WORDS, F.when(F.size(own) > 0, own).otherwise(known)))
        f = f.withColumn("d", F.transform("refs", lambda r: F.struct(js_distance(F.col("p"), r["p"]).alias("c"), js_distance(F.col("q"), r["q"]).alias("w"))))
        best = F.aggregate("d", F.lit(None).cast("struct<c:double,w:double>"), lambda a, x: F.when(a.isNull() | (x["c"] + x["w"] < a["c"] + a["w"]), x).otherwise(a))
        f = f.withColumn("best", best).withColumns({"js_chars": F.col("best.c"), "js_words": F.col("best.w")})
    else:
        f = f.withColumns({"js_chars": F.lit(None).cast("double"), "js_words": F.lit(None).cast("double")})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    far = F.coalesce((F.col("js_chars") > CHAR_LIMIT) | (F.col("js_words") > WORD_LIMIT), F.lit(False))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~far).alias("kept"), "js_chars", "js_words")
