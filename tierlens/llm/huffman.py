"""Canonical length-limited Huffman files of token ids.

Code lengths come from the counts of every id in the corpus by package-merge, limited
to ``max(MIN_BITS, bits of the number of ids + 1)`` bits; codes are canonical (by
length, then id), so a file set carries only the lengths.  Ids go in ascending doc_id
order into segments of at most ``SEGMENT`` ids.  A segment has one bit string cut into
blocks of ``BLOCK`` ids; the bit offset of each block is its checkpoint, so any block
is decoded without the others, and all blocks of a batch are decoded side by side with
one table of 2^limit entries.

File format (Parquet as the container, so any store works):
``ids``  shard, segment, first (ids of the shard before this segment), n, checkpoints
         (bit offsets of the blocks), bits (binary), doc_id, doc_no (of the first
         document), lens (ids of each document's piece in this segment)
``code`` id, bits: the code lengths

A null or empty text has only the end id.  Rows with equal doc_id are all kept, ordered
by the checksum of their ids; a null doc_id comes first.  An empty table gives empty
files.  Other columns are ignored.  A long document is cut into pieces over several
segments; its checksum is combined from theirs.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.session import scratch_path

from .common import pick, slices, small_batches, tidy
from .unicode_words import Recent, byte_chars, looked_up, pattern, tier

MIN_BITS = 16
BLOCK = 1024
SEGMENT = 1 << 17
SHARD_IDS = 8 << 20
CACHE_CHUNKS = 120_000
#: Text whose words are numbered together (a longer single text alone); common words are then looked at less often.
GATHER = 16 << 20
#: Fixed values, the byte-level vocabularies' split into endings, words, numbers, marks, blanks:
#: ``'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``
KINDS = ("[%S]", "[%L]", "[%N]")
WHITE, UNKNOWN = 0, 255
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class LibraryIds:
    """Ids of whole texts by the tokenizers library.

    For a byte-level vocabulary without normalizer the texts are split into its words
    and each distinct word goes through the library's BPE, once while it is
    remembered.  Texts in which a special string occurs, and all texts of other
    vocabularies, go through the library whole.
    """

    def __init__(self, spec: bytes):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_buffer(spec)
        spec = json.loads(spec)
        pre = spec["pre_tokenizer"] or {}
        self.by_words = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bpe, self.chars = self.lib.model, np.array([ord(c) for c in byte_chars()], "<u4")
        self.chars[0xFF] = ord(" ")  # neither is in a word: a byte that UTF-8 lacks, a character that stands for none
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn_kinds(np.arange(0x80))
        self.words = Recent(CACHE_CHUNKS)

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Sort code points not met before into white space, letters, numbers and marks."""
        for p in np.unique(points[self.kind[points] == UNKNOWN]).tolist():
            c = chr(p)
            self.kind[p] = next((k for k, kind in enumerate(KINDS) if pattern(kind, tier(c)).match(c)), len(KINDS))

    def _word_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        tokenize = self.bpe.tokenize
        chars = self.chars[np.frombuffer(b"\xff".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ids, end = [], [0]
        for w in chars.split(" "):
            ids += [t.id for t in tokenize(w)]
            end.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, end, end[1:])}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        flat, end = self.ids(pa.array(texts, pa.large_string()))
        return [flat[a:b].tobytes() for a, b in zip(end.tolist(), end[1:].tolist())]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each begin and end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.full(len(texts), not self.by_words)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_words(texts)
        asked = [np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.filter(pa.array(whole)).to_pylist()]
        flat, end = self._by_words(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts))
        end = np.concatenate([end, end[-1] + np.cumsum([len(x) for x in asked])])
        number = np.arange(len(texts))
        number[whole] = len(texts) + np.arange(len(asked))
        return _dealt(np.concatenate([flat, *asked]), end, number)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Arrow numbers the words, so each distinct one is looked at once for all texts; its
        ids are then dealt out by number."""
        _, at, raw = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if at[0] == at[-1]:
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        raw, at = np.frombuffer(raw, np.uint8)[at[0]:at[-1]], at - at[0]
        begins = self._word_begins(raw, at[:-1][np.diff(at) > 0])  # and the end of the last
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)]).dictionary_encode()
        at = np.searchsorted(begins, at)
        del begins, raw
        [of_word] = looked_up([coded.dictionary.to_numpy(zero_copy_only=False).tolist()], self.words, self._word_ids)
        end = np.cumsum([0, *map(len, of_word)]) // 4
        flat, end = _dealt(np.frombuffer(b"".join(of_word), "<u4"), end, coded.indices.to_numpy())
        return flat, end[at]

    def _word_begins(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin in the UTF-8 bytes of texts that begin at ``first``, then the end."""
        n = len(raw)
        kind = np.frombuffer(bytearray(raw.tobytes().translate(self.kind[:0x100].tobytes())), np.uint8)
        high = np.flatnonzero(raw >= 0x80)
        lead = high[raw[high] >= 0xC0]
        if len(high):  # all bytes of a character have its kind
            points = np.frombuffer(raw[high].tobytes().decode().encode("utf-32-le"), "<u4")
            self._learn_kinds(points)
            kind[high] = self.kind[points][np.searchsorted(lead, high, "right") - 1]
        edge, begin = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
        edge[first] = edge[n:] = True
        begin[1:n] = kind[1:] != kind[:-1]
        begin[first] = True
        # white space before a word: its last character is apart, and a blank belongs to the word
        at = np.flatnonzero((kind[1:] != WHITE) & (kind[:-1] == WHITE) & ~edge[1:n]) + 1
        last = at - 1
        wide = raw[last] >= 0x80
        last[wide] = lead[np.searchsorted(lead, last[wide], "right") - 1]
        begin[last] = True
        begin[at[raw[last] == 0x20]] = False
        # endings: a mark that begins a word takes the letters after it
        near = np.append(raw, [0, 0])
        at = np.flatnonzero((raw == ord("'")) & begin[:n])
        for ending in ENDINGS:
            fits = at
            for i, c in enumerate(ending, 1):
                fits = fits[(near[fits + i] == c) & ~edge[fits + i]]
            begin[fits + 1] = False
            begin[fits + 1 + len(ending)] = True
        begin[n] = True
        return np.flatnonzero(begin[:n + 1])


@lru_cache(1)
def library(spec: bytes) -> LibraryIds:
    """One for each Python worker: its later tasks know the words of those before."""
    return LibraryIds(spec)


def _dealt(flat: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists laid end to end (list k is ``flat[end[k]:end[k + 1]]``) those with the given
    numbers, laid out the same way."""
    size = np.diff(end)[number]
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    step = np.repeat(end[:-1][number] - out[:-1], size)
    step += np.arange(len(step))
    return flat[step], out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if 1 << limit < n:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[:len(both) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical codes of (id, length) pairs, and the decoding table."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray):
        order = np.lexsort((ids, lens))
        self.ids, self.lens = ids[order].astype(np.int64), lens[order].astype(np.int64)
        self.limit = int(self.lens.max())
        first = np.cumsum(1 << (self.limit - self.lens)) - (1 << (self.limit - self.lens))
        size = int(self.ids.max()) + 1
        self.code, self.len = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (first >> (self.limit - self.lens)).astype(np.uint64)
        self.len[self.ids] = self.lens
        width = 1 << (self.limit - self.lens)
        pad = (1 << self.limit) - int(width.sum())
        self.sym = np.concatenate([np.repeat(self.ids, width), np.zeros(pad, np.int64)]).astype(np.uint32)
        self.step = np.concatenate([np.repeat(self.lens, width), np.ones(pad, np.int64)])

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string of some ids and the bit offset of each block."""
        size = self.len[ids]
        end = np.cumsum(size)
        at = end - size
        word, room = at >> 6, 64 - (at & 63) - size
        code = self.code[ids]
        inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        out = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(inside, starts)
        over = np.flatnonzero(room < 0)  # at most one code crosses each word's end
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[:int(end[-1] + 7 >> 3)], at[::BLOCK]

    def unpack(self, bits: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of the blocks that begin at bits ``at`` and hold ``n`` ids, one after another."""
        if not len(at):
            return np.empty(0, np.uint32)
        buf = np.frombuffer(bits + b"\0" * 8, np.uint8)
        words = np.ndarray(len(buf) - 3, ">u4", buf, strides=(1,))
        order = np.argsort(-n, kind="stable")
        pos, left, shift = at[order].astype(np.int64), n[order], 32 - self.limit
        out, mask = np.empty((int(n.max()), len(at)), np.uint32), (1 << self.limit) - 1
        live = np.searchsorted(-left, -np.arange(1, len(out) + 1), "right")  # blocks with that many ids
        for k in range(len(out)):
            p = pos[:live[k]]
            key = words[p >> 3].astype(np.int64) >> (shift - (p & 7)) & mask
            out[k, :live[k]] = self.sym[key]
            p += self.step[key]
        back = np.empty(len(at), np.int64)
        back[order] = np.arange(len(at))
        return out.T[back][np.arange(len(out)) < n[:, None]]


def crc_combine(a: int, b: int, len_b: int) -> int:
    """crc32 of two byte strings put together, from theirs and the second's length."""
    def times(m, v):
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    m = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        m = [times(m, r) for r in m]  # one zero byte
    while len_b:
        if len_b & 1:
            a = times(m, a)
        len_b >>= 1
        m = [times(m, r) for r in m] if len_b else m
    return a ^ b


def tokenize(docs: DataFrame, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids) with the end id appended; ids are little-endian, 16 bit where the
    vocabulary allows it, else 32, as ``width`` tells."""
    with open(vocab_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    t = pick(docs, doc_id=id_col, text=text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        lib = library(sent.value)
        width = 2 if max(lib.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def work(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
            flat, at = lib.ids(pa.concat_arrays([b.column("text") for b in held]))
            if size > 2 * GATHER:  # the words of a long text are not kept beyond it
                lib.words = Recent(CACHE_CHUNKS)
            flat = np.insert(flat, at[1:], end_id)
            at = at + np.arange(len(at))
            raw, bounds = memoryview(flat).cast("B"), (4 * at).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
            ids = pa.py_buffer(flat.astype(f"<u{width}"))
            ids = pa.Array.from_buffers(pa.binary(), len(crc), [None, pa.array(width * at, pa.int32()).buffers()[1], ids])
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.column("doc_id") for b in held]), pa.array(np.diff(at)), pa.array(crc, pa.int64()),
                pa.array(np.full(len(crc), width, np.int32)), ids], names=["doc_id", "n", "crc", "width", "ids"])

        held, size = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                held.append(b)
                size += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
                if size >= GATHER:
                    yield work(held, size)
                    held, size = [], 0
        if held:
            yield work(held, size)
        held = []
        tidy()

    of_id = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(run, f"doc_id {of_id}, n long, crc long, width int, ids binary")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, count) over the whole corpus: one partial table per task, then a sum."""
    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for width in (2, 4):
                raw = b.filter(pc.equal(b.column("width"), width)).column("ids")
                flat = np.frombuffer(b"".join(raw.to_pylist()), f"<u{width}")
                if len(flat):
                    c = np.bincount(flat)
                    total = np.pad(total, (0, max(0, len(c) - len(total))))
                    total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "count"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


SEGMENTS = ("shard int, segment int, first long, n long, checkpoints array<long>, bits binary, "
            "doc_id array<long>, doc_no long, lens array<long>")


def _segments(sent):
    """Documents in order to rows of SEGMENTS; holds one segment of ids at a time."""
    def run(batches):
        code, shard = None, TaskContext.get().partitionId()
        hold, held, lens, names = [], 0, [], []
        state = {"segment": 0, "first": 0, "doc_no": 0}

        def flush(open_doc: bool):
            flat = np.concatenate(hold)
            bits, at = code.pack(flat)
            row = {"shard": [shard], "segment": [state["segment"]], "first": [state["first"]], "n": [len(flat)], "checkpoints": [at.tolist()],
                   "bits": [bits], "doc_id": [list(names)], "doc_no": [state["doc_no"]], "lens": [list(lens)]}
            state.update(segment=state["segment"] + 1, first=state["first"] + len(flat), doc_no=state["doc_no"] + len(lens) - open_doc)
            kind = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("checkpoints", pa.list_(pa.int64())),
                              ("bits", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("doc_no", pa.int64()), ("lens", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_pydict(row, kind)

        for b in batches:
            code = code or Code(*sent.value)
            for doc, width, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "width", "ids"))):
                ids = np.frombuffer(raw, f"<u{width}").astype(np.int64)
                while len(ids):
                    some, ids = ids[:SEGMENT - held], ids[SEGMENT - held:]
                    hold.append(some)
                    lens.append(len(some))
                    names.append(doc)
                    held += len(some)
                    if held == SEGMENT:
                        yield flush(len(ids) > 0)
                        hold, held, lens, names = [], 0, [], []
        if held:
            yield flush(False)
    return run


def write(docs: DataFrame, vocab_path: str, end_id: int, path: str, shard_ids: int = SHARD_IDS, **cols) -> None:
    """Tokenize whole texts and write the file set below ``path``."""
    spark = docs.sparkSession
    tokens = scratch_path(spark, "tokens")
    made = tokenize(docs, vocab_path, end_id, **cols)
    made.write.option("compression", "zstd").parquet(tokens)
    tokens = spark.read.schema(made.schema).parquet(tokens)
    counts = count_ids(tokens).toPandas().sort_values("id")  # bounded by the vocabulary
    ids, n = counts["id"].to_numpy(np.int64), counts["count"].to_numpy(np.int64)
    lens = code_lengths(n, max(MIN_BITS, int(len(n) - 1).bit_length() + 1)) if len(n) else n
    if len(lens) and lens.max() > 25:
        raise ValueError("a vocabulary of more than 2^24 ids needs a wider decoding window")
    spark.createDataFrame(pd.DataFrame({"id": ids, "bits": lens}), "id long, bits long").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast((ids, lens))
    shards = max(1, -(-int(n.sum()) // shard_ids))
    (tokens.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "crc")
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "n").select("doc_id", "width", "ids")
     .mapInArrow(_segments(sent), SEGMENTS).write.parquet(f"{path}/ids"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    code = spark.read.schema("id long, bits long").parquet(f"{path}/code").toPandas().sort_values("id")
    sent = spark.sparkContext.broadcast((code["id"].to_numpy(), code["bits"].to_numpy()))
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (segments.groupBy("shard").agg(F.sum("n").alias("n"))  # one row per shard
              .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))

    def run(batches):
        table = None
        for b in batches:
            table = table or Code(*sent.value)
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for lo in range(0, b.num_rows, 16):
                part = range(lo, min(lo + 16, b.num_rows))
                at, count, skip = [], [], 0
                for i in part:
                    at.append(np.array(cols["checkpoints"][i], np.int64) + 8 * skip)
                    count.append(np.minimum(BLOCK, cols["n"][i] - BLOCK * np.arange(len(at[-1]))))
                    skip += len(cols["bits"][i])
                flat = table.unpack(b"".join(cols["bits"][i] for i in part), np.concatenate(at), np.concatenate(count)).astype("<u4")
                out = {"shard": [], "doc_no": [], "doc_id": [], "start": [], "n": [], "crc": []}
                raw, here = memoryview(flat).cast("B"), 0
                for i in part:
                    first = cols["first"][i]
                    for k, (doc, n) in enumerate(zip(cols["doc_id"][i], cols["lens"][i])):
                        for c, v in zip(out, (cols["shard"][i], cols["doc_no"][i] + k, doc, first, n, zlib.crc32(raw[4 * here:4 * (here + n)]))):
                            out[c].append(v)
                        here += n
                        first += n
                yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("doc_no", pa.int64()), ("doc_id", pa.int64()),
                                                                 ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())]))

    pieces = segments.select("shard", "first", "n", "checkpoints", "bits", "doc_id", "doc_no", "lens").mapInArrow(
        run, "shard int, doc_no long, doc_id long, start long, n long, crc long")
    docs = pieces.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "crc", "n"))).alias("p"))

    @F.pandas_udf("long")
    def whole(crcs: pd.Series, lens: pd.Series) -> pd.Series:
        def one(cs, ns):
            total = int(cs[0])
            for c, n in zip(cs[1:], ns[1:]):
                total = crc_combine(total, int(c), 4 * int(n))
            return total
        return pd.Series([one(c, n) for c, n in zip(crcs, lens)], dtype="int64")

    docs = docs.withColumn("ids_crc32", whole(F.col("p.crc"), F.col("p.n")))
    return docs.join(shards, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocab_path: str, end_id: int, **cols) -> DataFrame:
    path = scratch_path(docs.sparkSession, "huffman")
    write(docs, vocab_path, end_id, path, **cols)
    return read(docs.sparkSession, path)
