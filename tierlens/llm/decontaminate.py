"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are maximal runs of digits, letters and characters beyond ASCII after A-Z are
lower-cased.  A window is ``n`` consecutive words of an item; an item with fewer words,
but at least one, is one window.  Training texts are turned into word numbers (words
that no item has share one number), windows made only of known words are hashed and
looked up, and each hit is verified against the exact windows.  A text word inside any
occurrence of a window is hit; ``spans`` are the merged hit word ranges.

A null or empty text has no words and no hits.  Repeated rows are judged alike, one
result per row.  Items that repeat an item_id count once; a null item_id is named
``null``.  An empty benchmark hits nothing; an empty table gives an empty result; other
columns pass through untouched, whatever their names.

What is broadcast is bounded: the benchmark's size is checked, and beyond
``BLOCK_BYTES`` of text it is worked off in blocks, one pass of the training table per
block with the hits so far stored in between.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, pick, position, positional, raw_text, restore, stored

N = 13
BLOCK_BYTES = 16 << 20
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


class Index:
    """Windows of some benchmark items: word numbers, window hashes, exact windows."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple, set]] = {}
        for name, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in text.encode("utf-8", "surrogatepass").translate(_KEEP).split()]
            m = min(n, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                self.windows.setdefault(m, {}).setdefault(tuple(w[i:i + m]), set()).add(name)
        self.hashes = {m: np.sort(self._hash(np.array(list(ws), dtype=np.int64).reshape(len(ws), m))) for m, ws in self.windows.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * _MUL
            h ^= h >> np.uint64(29)
        return h

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list], list[list]]:
        """Per text: number of words, merged hit ranges, names of the items that occur."""
        get, ids, counts = self.vocab.get, [], []
        gap = np.array([-1], dtype=np.int32)
        for b in texts:
            w = b.translate(_KEEP).split()
            counts.append(len(w))
            ids += [np.fromiter(map(get, w, repeat(-1)), np.int32, len(w)), gap]
        flat = np.concatenate(ids) if ids else gap[:0]
        first = np.cumsum([0, *[c + 1 for c in counts]])
        unknown = np.concatenate([[0], np.cumsum(flat < 0)])
        edge = np.zeros(len(flat) + 1, dtype=np.int32)
        names: list[set] = [set() for _ in texts]
        for m, known in self.hashes.items():
            at = np.flatnonzero(unknown[m:] == unknown[:-m]) if len(flat) >= m else np.empty(0, np.int64)
            for part in np.array_split(at, max(1, len(at) // 200_000)):
                if not len(part):
                    continue
                h = self._hash(np.lib.stride_tricks.sliding_window_view(flat, m)[part])
                at_h = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for p in part[known[at_h] == h].tolist():
                    items = self.windows[m].get(tuple(flat[p:p + m].tolist()))
                    if items:
                        edge[p] += 1
                        edge[p + m] -= 1
                        names[int(np.searchsorted(first, p, "right")) - 1] |= items
        hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        turn = np.diff(hit)
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        spans: list[list] = [[] for _ in texts]
        for x, y, d in zip(a.tolist(), b.tolist(), (np.searchsorted(first, a, "right") - 1).tolist()):
            spans[d].append([x - int(first[d]), y - int(first[d])])
        return counts, spans, [sorted(s) for s in names]


def _merge(old: list | None, new: list) -> list:
    out: list = []
    for a, b in sorted([list(x) for x in old or []] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id", item_text: str = "text",
         n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (distinct column names) with n_words, spans (hit word ranges), items."""
    items = pick(benchmark, item=item_col, text=item_text).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    sc = docs.sparkSession.sparkContext
    out = docs
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        # one block of the benchmark, bounded by block_bytes
        index = sc.broadcast(Index([("null" if r[0] is None else str(r[0]), r[1]) for r in own.toLocalIterator()], n))
        again = k > 0
        frame = out.withColumnsRenamed({"spans": "spans0", "items": "items0", "n_words": "n_words0"}) if again else out

        def start(index=index, again=again):
            ix = index.value

            def work(b: pa.RecordBatch) -> list:
                counts, spans, names = ix.scan(raw_text(b, text_col))
                if again:
                    spans = [_merge(o, s) for o, s in zip(b.column("spans0").to_pylist(), spans)]
                    names = [sorted({*(o or []), *s}) for o, s in zip(b.column("items0").to_pylist(), names)]
                return [counts, spans, names]
            return work

        got = map_text(frame, text_col, [("n_words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType()))], start)
        out = got.drop("spans0", "items0", "n_words0") if again else got
        if k + 1 < blocks:
            out = stored(out, "decontaminate")
    return out


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def contaminated(share: int = SHARE):
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
           share: int = SHARE, **more) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) for every row."""
    got = scan(pick(docs, doc_id=id_col, text=text_col), benchmark, "text", n=n, **more)
    return got.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      "items", "spans", contaminated(share).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = N,
                     share: int = SHARE, **more) -> DataFrame:
    """``docs`` without its contaminated rows."""
    got = scan(positional(docs), benchmark, f"p{position(docs, text_col)}", n=n, **more)
    return restore(got.where(~contaminated(share)), docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = N, **more) -> DataFrame:
    """``docs`` with the hit words (and what stands between them) cut out of the texts."""
    at = f"p{position(docs, text_col)}"
    got = scan(positional(docs), benchmark, at, n=n, **more)

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        def one(t, ranges):
            if t is None or ranges is None or not len(ranges):
                return t
            b, last, out = t.encode("utf-8", "surrogatepass"), 0, []
            words = [m.span() for m in _WORD.finditer(b)]
            for x, y in ranges:
                out.append(b[last:words[x][0]])
                last = words[y - 1][1]
            return b"".join([*out, b[last:]]).decode("utf-8", "surrogatepass")
        return pd.Series([one(t, r) for t, r in zip(text, spans)], dtype=object)

    return restore(got.withColumn(at, cut(at, "spans")), docs)
