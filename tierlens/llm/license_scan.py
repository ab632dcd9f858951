"""Licence scan by patience alignment.

Text and templates are taken as words (digits, letters and characters beyond ASCII,
A-Z lower-cased).  A stretch of text is aligned with a template by anchoring on the
words that occur exactly once in both, taking their longest increasing subsequence, and
aligning the gaps between anchors in the same way; a gap without anchors matches its
equal words at both ends.  ``coverage`` is the share of the template's words that are
matched.  A finding needs at least ``COVERAGE`` of them, and matched words must fill
``DENSITY`` of the stretch from the first to the last match.

Whole texts are scanned: stretches of twice the template's length (and ``SLACK`` words)
begin every half length, so an occurrence up to about one and a half times the
template's length lies whole in one.  A stretch (and before that the text) is skipped
only when its words cannot give the coverage, counted with their numbers.  In a stretch
that holds several occurrences few words occur once, so each stretch that is not skipped
is also aligned from every template word in it, over the template's length and over the
longest range that the density allows: these hold no second whole occurrence.  Of the findings of
one template that overlap, those stay that match the most words together (in the
shortest ranges, the first on ties): a single occurrence is the one with the highest coverage.

A null or empty text has no words and no findings; repeated rows are scanned alike; an
empty table gives an empty result; other columns are ignored.  The templates are a short
list of fixed texts, sent to the tasks with the code (at most ``MAX_WORDS`` words).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, pick, raw_text
from .decontaminate import _KEEP
from .license_texts import TEMPLATES

COVERAGE = 0.8
DENSITY = 0.6
SLACK = 8
MAX_WORDS = 1_000_000
FINDING = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _once(xs: list[int], lo: int, hi: int) -> dict[int, int]:
    """Place of each word that occurs once in a range."""
    place: dict[int, int] = {}
    for i in range(lo, hi):
        place[xs[i]] = -1 if xs[i] in place else i
    return {w: i for w, i in place.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (by first) whose second places increase."""
    tops, piles, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p:p + 1] = [j]
        piles[p:p + 1] = [k]
        back.append(piles[p - 1] if p else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (in template ``a``, in text ``b``), in order; words below 0 match nothing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        here, there = _once(a, i0, i1), _once(b, j0, j1)
        anchors = _increasing([(i, there[w]) for w, i in here.items() if w >= 0 and w in there])
        if anchors:
            out += anchors
            i, j = i0, j0
            for x, y in [*anchors, (i1, j1)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            continue
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float, density: float):
        self.coverage, self.density = coverage, density
        self.vocab: dict[bytes, int] = {}
        self.items = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words(t.encode())]) for name, t in texts.items()]
        self.items = [(name, ws) for name, ws in self.items if ws]
        if sum(len(ws) for _, ws in self.items) > MAX_WORDS:
            raise ValueError("the templates are meant to be a short list")
        self.counts = np.array([np.bincount(ws, minlength=len(self.vocab)) for _, ws in self.items]).reshape(len(self.items), -1)
        self.need = np.array([coverage * len(ws) for _, ws in self.items])

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        w = words(text)
        ids = np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int64, len(w))
        have = np.bincount(ids[ids >= 0], minlength=len(self.vocab))
        found = []
        for t in np.flatnonzero(np.minimum(have, self.counts).sum(1) >= self.need - 1e-9) if len(self.items) else ():
            found += self._stretches(ids, int(t))
        return len(w), sorted(found, key=lambda f: (f[2], f[0]))

    def _stretches(self, ids: np.ndarray, t: int) -> list[tuple]:
        name, template = self.items[t]
        width, step = 2 * len(template) + SLACK, max(1, len(template) // 2)
        found: set[tuple[int, int, int]] = set()
        done = 0
        for lo in range(0, max(1, len(ids) - width + step), step):
            part = ids[lo:lo + width]
            known = part[part >= 0]
            if len(known) < self.need[t] - 1e-9 or np.minimum(np.bincount(known, minlength=len(self.vocab)), self.counts[t]).sum() < self.need[t] - 1e-9:
                continue
            found |= self._aligned(part.tolist(), lo, t)
            found |= self._from_each_word(ids, max(lo, done), lo + len(part), t)
            done = lo + len(part)
        return [(name, n / len(template), start, end) for end, start, n in _most(sorted(found))]

    def _aligned(self, part: list[int], lo: int, t: int) -> set[tuple[int, int, int]]:
        """(end, start, matched words) of the template in a part that begins at ``lo``, if it is a finding."""
        pairs = align(self.items[t][1], part)
        if len(pairs) < self.need[t] - 1e-9:
            return set()
        start, end = lo + pairs[0][1], lo + pairs[-1][1] + 1
        return {(end, start, len(pairs))} if len(pairs) >= self.density * (end - start) else set()

    def _from_each_word(self, ids: np.ndarray, lo: int, hi: int, t: int) -> set[tuple[int, int, int]]:
        """Findings that begin in a range, aligned from each of the template's words there."""
        template, count = self.items[t][1], self.counts[t]
        widths = [len(template), int(len(template) / self.density + 1e-9)]
        part = ids[lo:hi + widths[1]].tolist()
        found: set[tuple[int, int, int]] = set()
        # the words of part[i:end], and how many of the template's they can match
        have, common, end = dict.fromkeys(template, 0), 0, 0
        for i in range(hi - lo):
            while end < min(len(part), i + widths[1]):
                if (w := part[end]) in have:
                    have[w] += 1
                    common += have[w] <= count[w]
                end += 1
            if (w := part[i]) in have:
                if common >= self.need[t] - 1e-9:
                    for width in widths:
                        found |= self._aligned(part[i:i + width], lo + i, t)
                common -= have[w] <= count[w]
                have[w] -= 1
        return found


def _most(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (end, start, matched) in order, those that do not overlap and match the most words,
    in the shortest ranges, the first on ties."""
    best, back = [(0, 0)], []  # of the first k: matched words and less than no range
    for k, (end, start, n) in enumerate(found):
        before = bisect_right(found, start, 0, k, key=lambda f: f[0])
        with_it = (best[before][0] + n, best[before][1] - (end - start))
        back.append(before if with_it > best[k] else -1)
        best.append(max(with_it, best[k]))
    out, k = [], len(found)
    while k:
        k -= 1
        if back[k] >= 0:
            out.append(found[k])
            k = back[k]
    return out[::-1]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, findings) for every row; findings: licence, coverage, word range."""
    def start():
        known = Templates(templates, coverage, density)

        def work(b: pa.RecordBatch) -> list:
            got = [known.scan(x) for x in raw_text(b, "text")]
            return [[n for n, _ in got], [[dict(zip(("license", "coverage", "start", "end"), f)) for f in fs] for _, fs in got]]
        return work

    t = pick(docs, doc_id=id_col, text=text_col)
    return map_text(t, "text", [("n_words", T.LongType()), ("findings", T.ArrayType(FINDING))], start).drop("text")
