"""BPE encoding and decoding with a contiguous rank array.

A short word is held as its parts (byte symbols at first) beside the ranks of adjacent
pairs.  Repeatedly the smallest rank is found by a scan (the leftmost on ties), the
boundary between its two parts is deleted, and the ranks of the two neighbouring pairs
are refreshed.  Words of equal length go through these steps together as the rows of
one numpy array: after k merges each row that is still merging has k parts fewer.  Words of more
than ``SHORT`` symbols take the same merges from a heap with linked neighbours, which
stays near linear for very long words.

The vocabulary is a ``tokenizers`` JSON file: byte-level BPE with an end-of-word
suffix, NFC and lower-casing, split at white space, letters, single digits, symbols.
Ids equal the library's ``encode(text, add_special_tokens=False).ids`` and the text its
``decode(ids, skip_special_tokens=False)`` (no decoder: token strings joined by a
blank).  Special strings inside a text become their ids, as in the library.

A null or empty text has no ids and decodes to the empty text; unknown ids are left
out by decoding; repeated rows give repeated results; an empty table an empty result;
other columns are ignored.  Each distinct word of a task is merged once; the word
caches hold at most twice ``CACHE_WORDS`` entries and some, so memory is bounded.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, pick
from .unicode_words import Recent, byte_chars, joined, looked_up, pattern, tier

SHORT = 40
CACHE_WORDS = 60_000
NONE = np.int32(2**31 - 1)


#: Letters, one digit, an English ending, symbols; the first character decides which.
WORD = "[%L]+|[%N]|'(?:s|t|re|ve|m|ll|d)|[^%S%L%N]+"


_SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def _normalizer():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


class RankBPE:
    def __init__(self, vocab_json: bytes):
        spec = json.loads(vocab_json)
        model, norm = spec["model"], spec["normalizer"] or {}
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a lower-casing BPE vocabulary with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.base = np.array([vocab[c] for c in byte_chars()], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in byte_chars()], dtype=np.int32)
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[s]] for m in merges], dtype=np.int64) for s in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = left * self.size + right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = np.append(keys, np.int64(2**62)), np.append(first, NONE).astype(np.int32), made
        self.pair_rank = dict(zip(keys.tolist(), first.tolist()))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words, self.chunks = Recent(CACHE_WORDS), Recent(CACHE_WORDS)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bit) of words of one length."""
        n, out = len(words[0]), [b""] * len(words)
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        part = self.base[raw]
        part[:, -1] = self.last[raw[:, -1]]
        rank = self._rank(part[:, :-1], part[:, 1:])
        row = np.arange(len(words))
        while True:
            k = part.shape[1]
            if k > 1:
                at = rank.argmin(1)
                best = rank[np.arange(len(rank)), at]
                done = best == NONE
            else:
                done = np.ones(len(part), bool)
            if done.any():
                flat = part[done].astype("<u4").tobytes()
                for i, r in enumerate(row[done].tolist()):
                    out[r] = flat[4 * k * i:4 * k * (i + 1)]
                if done.all():
                    return out
                live = ~done
                part, rank, row, at, best = part[live], rank[live], row[live], at[live], best[live]
            i = np.arange(len(part))
            part[i, at] = self.made[best]
            col = np.arange(k - 1)
            part = np.take_along_axis(part, col + (col > at[:, None]), 1)  # deletes the boundary
            if k > 2:
                col = col[:-1]
                rank = np.take_along_axis(rank, col + (col > at[:, None]), 1)
                for j in (at - 1, at):
                    ok = (j >= 0) & (j < k - 2)
                    ii, jj = i[ok], j[ok]
                    rank[ii, jj] = self._rank(part[ii, jj], part[ii, jj + 1])
            else:
                rank = rank[:, :0]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word, by a heap of pairs over linked parts."""
        part = [*self.base[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        n, size, find = len(part), self.size, self.pair_rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := find(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.made[r]), -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := find(part[i] * size + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            h = left[i]
            if h >= 0 and (r := find(part[h] * size + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return np.array([p for p in part if p >= 0], dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        by_len: dict[int, list[str]] = {}
        out = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > SHORT:
                out[w] = self.merge_long(b)
            else:
                by_len.setdefault(len(b), []).append(w)
        for same in by_len.values():
            for i in range(0, len(same), 20_000):
                some = same[i:i + 20_000]
                out.update(zip(some, self.merge_short([w.encode("utf-8", "surrogatepass") for w in some])))
        return out

    def _chunk_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of runs of characters other than white space: splitting never joins two runs."""
        return joined(chunks, [pattern(WORD, tier(c)).findall(c) for c in chunks], self.words, self.learn)

    @staticmethod
    def _runs(text: str) -> list[str]:
        if tier(text):
            # characters whose normal form or lower case depends on the Unicode version
            text = _normalizer().normalize_str(text)
        else:
            text = text.lower()
        # str.split() also cuts at these four controls, which the pattern takes as symbols
        return [text] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian 32 bit."""
        cut = self.split_special
        parts = [[t or ""] if t is None or cut is None or "<" not in t else cut.split(t) for t in texts]
        todo = [sum([[p] if i % 2 else self._runs(p) for i, p in enumerate(ps)], []) for ps in parts]
        # a special string as a part of its own stands for itself
        self.chunks.new.update([(t, i.to_bytes(4, "little")) for t, i in self.special.items()])
        return [b"".join(x) for x in looked_up(todo, self.chunks, self._chunk_ids)]

    def decode(self, ids: list[bytes | None]) -> list[str]:
        if not hasattr(self, "strings"):
            self.strings = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        get, out = self.strings.__getitem__, []
        for b in ids:
            at = np.frombuffer(b or b"", "<u4").tolist()
            try:
                out.append(" ".join(map(get, at)))
            except (IndexError, TypeError):  # an id beyond the vocabulary, or a gap in it
                out.append(" ".join([self.tokens[i] for i in at if i in self.tokens]))
        return out


def _sent(df: DataFrame, vocab_path: str):
    """The vocabulary file (a few MB, read once by the driver) for the tasks."""
    with open(vocab_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ``ids`` is the token ids as little-endian unsigned 32-bit integers."""
    sent = _sent(docs, vocab_path)
    t = pick(docs, **{id_col: id_col, "text": text_col})

    def start():
        m = RankBPE(sent.value)  # one per task: its caches end with it
        return lambda b: [m.encode(b.column("text").to_pylist())]

    return map_text(t, "text", [("ids", T.BinaryType())], start, drop=True)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) from (id, ids)."""
    sent = _sent(encoded, vocab_path)
    t = pick(encoded, **{id_col: id_col, "ids": ids_col})

    def start():
        m = RankBPE(sent.value)  # one per task: its caches end with it
        return lambda b: [pa.array(m.decode(b.column("ids").to_pylist()), pa.string())]

    return map_text(t, "ids", [("text", T.StringType())], start)


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text) of :func:`decode` after :func:`encode`, in one pass: one Python worker and
    one vocabulary for each core instead of two."""
    sent = _sent(docs, vocab_path)
    t = pick(docs, **{id_col: id_col, "source": text_col})

    def start():
        m = RankBPE(sent.value)  # one per task: its caches end with it

        def work(b: pa.RecordBatch) -> list:
            ids = m.encode(b.column("source").to_pylist())
            return [ids, pa.array(m.decode(ids), pa.string())]
        return work

    return map_text(t, "source", [("ids", T.BinaryType()), ("text", T.StringType())], start, drop=True)
