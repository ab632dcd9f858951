"""Importance resampling towards a target: scores from an array of gains, ranks from a
distributed LSD radix sort.

Features are all runs of ``n_min`` to ``n_max`` consecutive words (joined by one space,
repeats counted); words are maximal runs of digits, letters and characters beyond ASCII
after A-Z are lower-cased.  A feature's bucket is its CRC-32 modulo ``buckets``.  Counts
per bucket over both whole tables give one array of gains; a text's weight is the floored
mean of its features' gains, and its score adds Gumbel noise hashed from seed and id, so
that the highest scores are a draw without replacement in proportion to the weights.

The sort never compares rows.  Rows have a composite key of unsigned digits: the distance
from the highest score, a bit for a null id, and the distance from the least id.  From the
last digit to the first, one stable counting pass each:

* rows lie in blocks by their place so far; Spark counts rows per (block, digit);
* the prefix sums of these counts by (digit, block) are each block's first destinations;
* a task holds one block and gives each row ``first destination + rank in its digit``.

Destinations are all places 0, 1, 2, ... once, so the next pass's blocks have one size
whatever the keys are: a score or id shared by a third of the rows fills several blocks and
no task gets more than a block.  A block has ``max(BLOCK, n / MAX_BLOCKS)`` rows.  Each pass
moves every row once and is written, so a lost executor costs one pass at most.

A null or empty text has no words and the weight 0.  A null id counts as an empty string in
the noise and comes after all ids in ties; repeated rows are ranked apart, equal ones in any
order.  Ids are integers (any width) or are first put in order by Spark's range sort, which
is then the pass of least significance.  An empty target or corpus has zero counts; an empty
corpus gives an empty result.  Very long texts are worked off in pieces.  Other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, pick, raw_text, slices, stored

BUCKETS, SCALE = 10_000, 1000
DIGIT = 11
BLOCK, MAX_BLOCKS = 4096, 4096
#: Text split into words at once, and words whose bucket a task remembers.
PIECE, CACHE = 1 << 20, 500_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class Buckets:
    """Buckets of the features of a text, in arrays of bounded size."""

    def __init__(self, n_min: int, n_max: int, buckets: int):
        self.n_min, self.n_max, self.buckets, self.known = n_min, n_max, buckets, {}

    def _of(self, features: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.buckets
        return np.fromiter(map(known.__getitem__, features), np.int64, len(features))

    def arrays(self, text: bytes):
        """Pieces end between words; the last words before a cut go on into the next piece."""
        at, before = 0, []
        while at < len(text):
            cut = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            words = before + _WORD.findall(text[at:end].translate(_LOWER))
            for n in range(self.n_min, self.n_max + 1):
                new = range(max(0, len(before) - n + 1), len(words) - n + 1)          # runs that end in this piece
                features = words[len(before):] if n == 1 else [b" ".join(words[i:i + n]) for i in new]
                if features:
                    yield self._of(features)
            before, at = words[max(0, len(words) - self.n_max + 1):] if self.n_max > 1 else [], end


def bucket_counts(docs: DataFrame, text: str = "text", n_min: int = 1, n_max: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts: one array per task, added up by Spark."""
    def run(batches):
        total, find = np.zeros(buckets, np.int64), Buckets(n_min, n_max, buckets)
        held: list[np.ndarray] = []
        for b in chain.from_iterable(slices(b, "text") for b in batches):
            for at in chain.from_iterable(map(find.arrays, raw_text(b, "text"))):
                held.append(at)
                if len(held) > 1000 or len(at) > 100_000:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held = []
        total += np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    got = pick(docs, text=text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln of the smoothed ratio of the target's to the source's share) per bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log(((t + 1.0) * (s_all + k)) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: int, doc_id) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, text: str = "text", doc_id: str = "doc_id", n_min: int = 1, n_max: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    def start():
        find = Buckets(n_min, n_max, len(gain))

        def work(b):
            words, n, weight = [], [], []
            for body in raw_text(b, "text"):
                count = total = 0
                for at in find.arrays(body):
                    count += len(at)
                    total += int(gain[at].sum())
                words.append(count if (n_min, n_max) == (1, 1) else sum(1 for _ in _WORD.finditer(body.translate(_LOWER))))
                n.append(count)
                weight.append(total // count if count else 0)
            score = [w + noise(seed, d) for w, d in zip(weight, b.column("doc_id").to_pylist())]
            return [words, n, weight, score]
        return work

    fields = [(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    return map_text(pick(docs, doc_id=doc_id, text=text), "text", fields, start, drop=True)


# ---------------------------------------------------------------- LSD radix sort
def _digits(name: str, bits: int) -> list[tuple[str, int, int]]:
    """(key column, shift, width) from the least significant digit on, of even widths."""
    passes = -(-bits // DIGIT)
    cuts = [bits * i // passes for i in range(passes + 1)] if passes else [0]
    return [(name, a, b - a) for a, b in zip(cuts, cuts[1:])]


def _pass(rows: DataFrame, digit: tuple[str, int, int], size: int) -> DataFrame:
    """One stable counting pass: ``rows`` (block, place, ...) with their new block and place."""
    key, shift, width = digit
    value = F.shiftrightunsigned(key, shift).bitwiseAND((1 << width) - 1)
    counts = stored(rows.groupBy("block", value.alias("digit")).agg(F.count(F.lit(1)).alias("n")), "radix-counts")
    total = {r.digit: r.n for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}       # at most 2^DIGIT rows
    before, base = 0, []
    for d in sorted(total):
        base.append((d, before))
        before += total[d]
    bases = rows.sparkSession.createDataFrame(base, "digit long, base long")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (counts.withColumn("earlier", earlier).join(F.broadcast(bases), "digit")
              .select("block", "digit", (F.col("base") + F.col("earlier")).alias("first")))
    names = rows.columns

    def move(block: pa.Table, first: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(get(block, "place"))
        block = block.take(pa.array(order))
        at = ((get(block, key).astype(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        stable = np.argsort(at, kind="stable")                  # counting sort of small digits
        digits, begin, count = np.unique(at[stable], return_index=True, return_counts=True)
        known = dict(zip(get(first, "digit").tolist(), get(first, "first").tolist()))
        place = np.empty(len(at), np.int64)
        place[stable] = np.repeat([known[d] for d in digits.tolist()], count) + np.arange(len(at)) - np.repeat(begin, count)
        new = {"block": pa.array(place // size), "place": pa.array(place)}
        return pa.table({c: new.get(c, block.column(c)) for c in names})

    moved = rows.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(move, rows.schema)
    return stored(moved, "radix-rows")


def ranked(rows: DataFrame, score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """The rows with ``place`` (0, 1, 2, ...): highest score first, ties to the smaller id.
    ``rows`` should be a stored table; its columns must not be named block, place, high or low."""
    whole = isinstance(rows.schema[doc_id].dataType, T.IntegralType)
    if not whole:
        rows = rows.orderBy(F.col(doc_id).asc_nulls_last())      # the pass of least significance, by ranges
    n, top, least, most, low_id, high_id, nulls = rows.agg(
        F.count(F.lit(1)), F.max(score), F.min(score), F.lit(0), *([F.min(doc_id), F.max(doc_id)] if whole else [F.lit(0), F.lit(0)]),
        F.count_if(F.col(doc_id).isNull())).first()
    if not n:
        return rows.withColumn("place", F.lit(None).cast("long"))
    # 64-bit differences wrap around as unsigned numbers do; try_ functions would give null
    low = F.lit(0).cast("long") if not whole or low_id is None else F.coalesce(_minus(F.col(doc_id).cast("long"), low_id), F.lit(0).cast("long"))
    high = (F.lit(top) - F.col(score)) * 2 + F.col(doc_id).isNull().cast("long")
    number = F.monotonically_increasing_id()
    size = max(BLOCK, -(-n // MAX_BLOCKS))
    keyed = rows.select("*", high.cast("long").alias("high"), low.alias("low"), number.alias("place"))
    keyed = stored(keyed.withColumn("block", F.shiftright("place", 33)), "radix-rows")       # first blocks: the tasks' rows
    low_bits = int(high_id - low_id).bit_length() if whole and low_id is not None else 0
    high_bits = (2 * (top - least) + (1 if nulls else 0)).bit_length()
    for digit in _digits("low", low_bits) + _digits("high", max(1, high_bits)):
        keyed = _pass(keyed, digit, size)
    return keyed.drop("block", "high", "low")


def _minus(c, least: int):
    """c - least in 64 bits without overflow errors: halves are subtracted apart."""
    mask = 0xFFFFFFFF
    lo = c.bitwiseAND(mask) - (least & mask)
    hi = F.shiftright(c, 32) - (least >> 32) - F.when(lo < 0, 1).otherwise(0)
    return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(mask))


def draw(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", n_min: int = 1, n_max: int = 1,
         buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """Each row's doc_id, n_features, weight, score and rank: 1, 2, 3, ... for the
    floor(percent * N / 100) best of the N rows with at least ``min_words`` words, else null."""
    gain = gains(bucket_counts(docs, text, n_min, n_max, buckets), bucket_counts(target, target_text, n_min, n_max, buckets))
    rows = stored(scored(docs, gain, seed, text, doc_id, n_min, n_max), "resample-scores")
    fit = rows.where(F.col("n_words") >= min_words)
    take = percent * fit.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    place = ranked(fit).select(*out, F.when(F.col("place") < take, F.col("place") + 1).alias("rank"))
    return place.unionByName(rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, drawn: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn; a null id is never drawn here."""
    ids = drawn.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs[doc_id] == ids["drawn_id"], "left_semi")
