"""Exact selection of the first k rows of each label in hash order, without sorting or
moving the rows.

A label's k-th smallest row is found by refining histograms: counts per (label, next bits of
the hash) are added up by Spark (they merge, so each task sends at most one row per label and
bucket), the bucket that holds the k-th row is the only one looked at in the next round, and
a bucket of at most ``LIST`` rows is listed.  What reaches the driver is one row per label and
round.  The thresholds are then literals: the rows are read once more and each is compared
with its label's threshold, with no join, window or shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose thresholds or counts may be held as literals; more are an error.
MAX_CLASSES = 100
#: A bucket of at most so many rows is listed instead of split further.
LIST = 4096
HASH_BITS = 256


@dataclass(frozen=True)
class Threshold:
    """The k-th row of a label in (hash, keys) order; ``within`` rows equal to it are chosen,
    of ``equal`` that there are."""

    label: object
    at: tuple
    within: int
    equal: int


def check_classes(n: int) -> None:
    if n > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per label, NULL left out: one aggregate, at most ``MAX_CLASSES`` rows fetched."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    check_classes(len(rows))
    return {r[0]: r.n for r in rows}


def _bits(h: str, start: int, n: int) -> Column:
    """Bits start..start + n of a hexadecimal hash as a number (n at most 28)."""
    first, last = start // 4, -(-(start + n) // 4)
    value = F.conv(F.substring(h, first + 1, last - first), 16, 10).cast("long")
    return F.shiftright(value, 4 * last - start - n).bitwiseAND((1 << n) - 1)


def _same(label: str, value) -> Column:
    return F.col(label) == F.lit(value)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def thresholds(df: DataFrame, label: str, keys: list[str], h: Column, target: Callable[[Column], Column], bits: int) -> list[Threshold]:
    """The threshold of each label that ``target`` (of its number of rows) wants any row of."""
    rows = df.where(F.col(label).isNotNull()).select(label, *keys, h.alias("_h"))
    todo: dict = {None: (None, 0, [])}                                # label: rows still needed, bits known, values of these bits
    out: list[Threshold] = []

    def inside(x, path) -> Column:
        c = F.lit(True) if x is None else _same(label, x)
        for start, n, value in path:
            c = c & (_bits("_h", start, n) == value)
        return c
    while todo:
        start = next(iter(todo.values()))[1]                          # all labels advance together
        n = min(bits, HASH_BITS - start)
        if n <= 0:                                                    # equal hashes
            return out + _listed(rows, label, keys, {x: (k, inside(x, path)) for x, (k, _, path) in todo.items()})
        counts = (rows.where(_any([inside(x, path) for x, (_, _, path) in todo.items()]))
                  .groupBy(label, _bits("_h", start, n).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
        of_label = Window.partitionBy(label)
        need = target(F.sum("_n").over(of_label))
        if None not in todo:
            need = F.lit(None).cast("long")
            for x, (k, _, _) in todo.items():
                need = F.when(_same(label, x), F.lit(k)).otherwise(need)
        running = F.sum("_n").over(of_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = counts.select(label, "_b", "_n", running.alias("_cum"), need.alias("_need")).where("_need > 0 and _cum >= _need and _cum - _n < _need")
        found = hit.limit(MAX_CLASSES + 1).collect()                  # one row per label
        check_classes(len(found))
        before, todo, small = todo, {}, {}
        for r in found:
            path = [*before.get(r[0], before.get(None, (0, 0, [])))[2], (start, n, r._b)]
            k = r._need - (r._cum - r._n)
            if r._n <= LIST:
                small[r[0]] = (k, inside(r[0], path))
            else:
                todo[r[0]] = (k, start + n, path)
        if small:
            out += _listed(rows, label, keys, small)
    return out


def _listed(rows: DataFrame, label: str, keys: list[str], buckets: dict) -> list[Threshold]:
    """The k-th row of each label's bucket: equal rows are counted, the few different ones listed."""
    found = (rows.where(_any([c for _, c in buckets.values()])).groupBy(label, "_h", *keys).agg(F.count(F.lit(1)).alias("_n"))
             .groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_h", *keys, "_n"))).alias("rows")))
    out = []
    for r in found.collect():
        k = buckets[r[0]][0]
        for row in r.rows:
            if k <= row._n:
                out.append(Threshold(r[0], tuple(row)[:-1], k, row._n))
                break
            k -= row._n
    return out


def chosen(df: DataFrame, label: str, keys: list[str], h: Column, found: list[Threshold], name: str) -> DataFrame:
    """``df`` with the flag ``name``: up to its label's threshold.

    Rows that share hash and keys with a threshold and are only partly chosen (one key on
    several rows) are numbered; without such a case the rows are read once and stay put."""
    types = {c: df.schema[c].dataType for c in keys}
    own = F.struct(h.alias("_h"), *[F.col(c) for c in keys])

    def literal(t: Threshold) -> Column:
        return F.struct(F.lit(t.at[0]).alias("_h"), *[F.lit(v).cast(types[c]).alias(c) for c, v in zip(keys, t.at[1:])])
    flag = F.lit(False)
    for t in found:
        flag = F.when(_same(label, t.label), own <= literal(t)).otherwise(flag)
    split = [t for t in found if t.within < t.equal]
    if not split:
        return df.select("*", F.coalesce(flag, F.lit(False)).alias(name))
    at_edge = F.coalesce(_any([_same(label, t.label) & (own == literal(t)) for t in split]), F.lit(False))
    number = F.row_number().over(Window.partitionBy(label).orderBy(*keys))
    few = F.lit(0)
    for t in split:
        few = F.when(_same(label, t.label), F.lit(t.within)).otherwise(few)
    clear = df.where(~at_edge).select("*", F.coalesce(flag, F.lit(False)).alias(name))
    return clear.unionByName(df.where(at_edge).select("*", (number <= few).alias(name)))
