"""Language identification with a byte convolutional network written in numpy.

A text is cut into windows of ``WINDOW`` bytes (the last one padded with zero bytes).
Each byte is embedded; filters of the widths ``WIDTHS`` slide over the window, a
rectifier and max pooling over all places follow, then a softmax over the languages.
A text's distribution is the byte-weighted geometric mean of its windows'; every window
of a text counts, none is skipped.

Training (``fit``) uses a bounded sample of labelled rows: about ``SAMPLE_DOCS``
documents, spread evenly over the languages and chosen by a hash of the id, four
passages of ``WINDOW`` characters from each.  All labels are learned; more than
``MAX_LANGS`` of them are an error.  Only text and label are looked at; prediction reads the text alone.

A null text and a text without a letter are ``und`` with score 0.0, and so is any text
when nothing could be learned.  With one learned language every other text gets it with
score 1.0.  Repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, pick, position, positional, raw_text, restore

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
SAMPLE_DOCS = 3000
PASSAGES = 4
MAX_LANGS = 1000
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"

_LETTER = re.compile("[A-Za-z]")
_SPACE = 1 << 30


def has_letter(text: str | None) -> bool:
    return text is not None and bool(_LETTER.search(text) or any(map(str.isalpha, text)))


def windows(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, k = max(WIDTHS), len(WIDTHS) * FILTERS
        self.langs, self.wide = langs, wide
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        # a narrower filter is a wide one whose last rows stay zero
        self.mask = np.repeat(np.array([[j < w for w in WIDTHS for _ in range(FILTERS)] for j in range(wide)], np.float32), EMBED, 0)
        self.conv = (rng.normal(0, (wide * EMBED) ** -0.5, (wide * EMBED, k)) * self.mask).astype(np.float32)
        self.bias = np.zeros(k, np.float32)
        self.out = rng.normal(0, k ** -0.5, (k, len(langs))).astype(np.float32)
        self.off = np.zeros(len(langs), np.float32)

    def _pool(self, x: np.ndarray):
        b, n = x.shape
        e = self.emb[np.pad(x, ((0, 0), (0, self.wide - 1)))].reshape(b, -1)
        cols = np.lib.stride_tricks.sliding_window_view(e, self.wide * EMBED, axis=1)[:, ::EMBED]
        a = (cols.reshape(b * n, -1) @ self.conv).reshape(b, n, -1)
        return cols, a

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        _, a = self._pool(x)
        z = np.maximum(a.max(1) + self.bias, 0) @ self.out + self.off
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out, self.off]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                at = order[lo:lo + BATCH]
                xb, yb, rows = x[at], y[at], np.arange(len(at))
                cols, a = self._pool(xb)
                top = a.argmax(1)
                raw = np.take_along_axis(a, top[:, None, :], 1)[:, 0] + self.bias
                h = np.maximum(raw, 0)
                z = h @ self.out + self.off
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, yb] -= 1
                dz = p * weight[yb][:, None] / len(at)
                dh = (dz @ self.out.T) * (raw > 0)
                seen = cols[rows[:, None], top]  # what each filter saw at its maximum
                dconv = np.einsum("bfc,bf->cf", seen, dh) * self.mask
                demb = np.zeros_like(self.emb)
                back = (dh[:, :, None] * self.conv.T[None]).reshape(len(at), -1, self.wide, EMBED)
                padded = np.pad(xb, ((0, 0), (0, self.wide - 1)))
                for j in range(self.wide):
                    np.add.at(demb, padded[rows[:, None], top + j], back[:, :, j])
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS)
                for i, g in enumerate([demb, dconv, dh.sum(0), h.T @ dz, dz.sum(0)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    params[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its probability, for each text."""
        cut = [windows(t) for t in texts]
        flat = np.concatenate(cut)
        logs = np.concatenate([self.log_probs(flat[i:i + 256]) for i in range(0, len(flat), 256)])
        own = np.concatenate([np.minimum(WINDOW, np.maximum(1, len(t) - WINDOW * np.arange(len(c)))) for t, c in zip(texts, cut)])
        first = np.cumsum([0, *map(len, cut[:-1])])
        mean = np.add.reduceat(logs * own[:, None], first) / np.add.reduceat(own, first)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS) -> ByteCNN:
    """Learn from a bounded sample of ``labelled`` (rows without label or letters do not count)."""
    rows = pick(labelled, id=id_col, text=text_col, lang=label_col).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts.sort(key=lambda r: (-r["count"], r["lang"]))
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return ByteCNN([])
    quota = sample_docs / len(langs)
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(_SPACE, int(_SPACE * quota / r["count"])))])
    place = F.pmod(F.xxhash64("id"), F.lit(_SPACE))
    end = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = F.array_distinct(F.array(*[F.substring("text", (end * k / max(1, PASSAGES - 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(PASSAGES)]))
    got = (rows.where(place < F.element_at(limit, F.col("lang"))).select("lang", cuts.alias("cuts"), F.xxhash64("id").alias("h"))
           .orderBy("h", "cuts").limit(2 * sample_docs).collect())  # a bounded sample
    net = ByteCNN(langs)
    xy = [(w[0], langs.index(r["lang"])) for r in got for c in r["cuts"] if c for w in [windows(c.encode()[:WINDOW])]]
    if len(langs) > 1 and xy:
        net.fit(np.array([x for x, _ in xy]), np.array([y for _, y in xy]))
    return net


def _judge(docs: DataFrame, text_col: str, net: ByteCNN) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few KB: fixed by the network's shape

    def start():
        cnn = sent.value

        def work(b: pa.RecordBatch) -> list:
            ok = [i for i, t in enumerate(b.column(text_col).to_pylist()) if cnn.langs and has_letter(t)]
            lang, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            if ok:
                raw = raw_text(b, text_col)
                for i, k, p in zip(ok, *cnn.predict([raw[i] for i in ok])):
                    lang[i], score[i] = cnn.langs[int(k)], min(1.0, float(p))
            return [lang, score]
        return work

    return map_text(docs, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType())], start)


def predict(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    return _judge(pick(docs, **{id_col: id_col, "text": text_col}), "text", net).drop("text")


def keep_known(docs: DataFrame, net: ByteCNN, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are ``und`` or judged with less than ``min_score``."""
    got = _judge(positional(docs), f"p{position(docs, text_col)}", net)
    return restore(got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs)
