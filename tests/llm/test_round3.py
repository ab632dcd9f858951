"""Exact dedup, vector codes and importance resampling: small cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.llm import exact_dedup, resample, vector_codes
from tierlens.llm.common import stored


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- 11 exact dedup
def brute_classes(docs):
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    out = {}
    for norm, members in groups.items():
        best = min(members, key=lambda i: (-len(docs[i][1] or ""), docs[i][0] is None, docs[i][0] or 0))
        for i in members:
            out[i] = (docs[i][0], docs[best][0], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return sorted(out.values(), key=repr), len(groups)


def test_exact_dedup_against_brute_force(spark):
    random.seed(3)
    long = "x" * exact_dedup.PREFIX
    base = [None, "", " \n", "a b", "ab", "a  b", "AB", "é a", "éa", "中文 字", long + "one", long + "two", long + " one", "a b", "a\x0bb"]
    docs = [(i if random.random() < 0.9 else None, random.choice(base)) for i in range(120)] + [(500, "hot text")] * 80 + [(7, "hot  text"), (9, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = exact_dedup.classes(df, digest=True)
    want, n_groups = brute_classes(docs)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()], key=repr) == want
    assert got.where("kept").count() == n_groups
    assert got.where("kept and not (doc_id <=> keep_id)").count() == 0


def test_exact_dedup_odd(odd, none, spark):
    got = rows(exact_dedup.classes(odd))
    assert len(got) == 12 and sum(r[3] for r in got) == 9                  # 1 = 2 = 3 (blank), 6 twice
    assert {r[:3] for r in got if r[0] in (1, 2, 3)} == {(1, 3, 3), (2, 3, 3), (3, 3, 3)}
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 6, 7, 7, 8, 9]
    assert exact_dedup.classes(none, digest=True).count() == 0 and exact_dedup.dedup(none).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "z")], "id string, body string")
    assert sorted(rows(exact_dedup.classes(named, "body", "id"))) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_exact_dedup_is_native_and_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.classes(docs, digest=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|InPandas", plan)
    met = exact_dedup._refined(docs, "text")._jdf.queryExecution().executedPlan().toString()
    for line in met.splitlines():
        if "Exchange hashpartitioning" in line:
            assert re.search(r"hashpartitioning\((word|size|prefix)", line)


def test_exact_dedup_full_hash_only_for_survivors(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "longer text"), (5, "other words")], "doc_id long, text string")
    full = {r.doc_id: r.full for r in exact_dedup._refined(docs, "text").select("doc_id", "full").collect()}
    assert full[1] == full[3] is not None and full[2] is None and full[4] is None and full[5] is None


# ---------------------------------------------------------------- 12 vector codes
def brute_lloyd(vectors, ids, parts, entries, rounds):
    """Plain Lloyd on Python integers: codebooks and, per vector, (codes, error)."""
    x = [[int(v) for v in vector_codes.integers(u).tolist()] for u in vectors]
    w = len(x[0]) // parts
    first = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, vectors[i]))[:entries]
    books = [[x[i][p * w:(p + 1) * w] for i in first] for p in range(parts)]

    def near(u, book):
        return min((sum((a - b) ** 2 for a, b in zip(u, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for u in x:
                mine[near(u[p * w:(p + 1) * w], books[p])[1]].append(u[p * w:(p + 1) * w])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, books[p])]
    out = []
    for u in x:
        got = [near(u[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append((bytes(k for _, k in got), sum(d for d, _ in got)))
    return books, out


@pytest.mark.parametrize("n, width, parts, entries, kind", [(1, 8, 8, 16, "ties"), (7, 4, 2, 16, "ties"), (300, 6, 2, 5, "ties"), (700, 8, 2, 16, "clusters"),
                                                            (500, 16, 8, 7, "wide"), (400, 4, 4, 16, "hot")])
def test_vector_codes_against_plain_lloyd(spark, n, width, parts, entries, kind):
    rng = np.random.default_rng(n)
    if kind == "ties":
        v = rng.integers(-2, 3, (n, width)) / 4096
    elif kind == "clusters":
        v = rng.integers(0, 6, (n, 1)) * 100.0 + rng.normal(size=(n, width))
    else:
        v = rng.normal(size=(n, width))
    if kind == "hot":
        v[rng.random(n) < 0.4] = v[0]
    ids = [int(i) if rng.random() < 0.98 else None for i in rng.permutation(n)]
    vectors = [[float(c) for c in u] for u in v]
    labels = [int(k) if k else None for k in rng.integers(0, 3, n)]
    df = spark.createDataFrame(list(zip(ids, vectors, labels)), "vec_id long, embedding array<double>, label int").repartition(3)
    chunks, books = vector_codes.train(df, parts=parts, entries=entries)
    want_books, want = brute_lloyd(vectors, ids, parts, entries, vector_codes.ROUNDS)
    assert [b.tolist() for b in books] == want_books
    got = vector_codes.with_label_error(vector_codes.encode(chunks, books)).collect()
    assert sorted([(r.vec_id, bytes(r.codes), r.error) for r in got], key=repr) == sorted([(i, c, e) for i, (c, e) in zip(ids, want)], key=repr)
    sums = {k: sum(e for (_, e), lab in zip(want, labels) if lab == k) for k in set(labels)}
    assert all(r.label_error == sums[r.label] for r in got)


def test_whole_nodes_are_assigned_by_cached_sums():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 5, (2000, 1)) * 100_000 + rng.integers(0, 1000, (2000, 4))
    tree = vector_codes.PartTree.build(points)
    entries = vector_codes.EntryTree(np.array([[100_000 * k + 500] * 4 for k in (3, 1, 4, 0, 2)]))
    whole = [np.diff(tree.cuts[lv])[at].sum() for lv, at, _ in vector_codes.assign(tree, entries) if lv is not None]
    assert sum(whole) > 1800 and len(whole) > 1                            # most parts are never looked at alone
    sums = vector_codes.entry_sums(tree, entries)
    near = ((points[:, None] - entries.entries[None]) ** 2).sum(2).argmin(1)
    assert sums[:, -1].tolist() == np.bincount(near, minlength=5).tolist()
    assert all(sums[k, :-1].tolist() == points[near == k].sum(0).tolist() for k in range(5))


def test_vector_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [0.5, -0.5], None), (None, [2.0, 1.0], 3), (1, [0.5, -0.5], None)]
    bad = [(2, None, 1), (3, [1.0, None], 1), (4, [nan, 0.0], 1), (5, [0.0, -inf], 1)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in kept + bad], "vec_id long, embedding array<float>, label int, `EMBEDDING2` string, error double")
    chunks, books = vector_codes.train(df, parts=2)
    got = vector_codes.with_label_error(vector_codes.encode(chunks, books)).collect()
    assert sorted([(r.vec_id, r.error, r.label_error) for r in got], key=repr) == [(1, 0, 0), (1, 0, 0), (None, 0, 0)]
    assert [b.shape for b in books] == [(3, 1), (3, 1)]
    chunks, books = vector_codes.train(df.where("false"))
    assert books == [] and vector_codes.with_label_error(vector_codes.encode(chunks, books)).count() == 0
    for rows_ in ([(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], [(1, [1e30] * 8, 0)]):
        with pytest.raises(Exception, match="length|64-bit"):
            chunks, books = vector_codes.train(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ValueError, match="divide"):
        vector_codes.train(spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int"))


# ---------------------------------------------------------------- 13 importance resampling
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, lo, hi):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return w, [" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def brute_draw(docs, target, lo=1, hi=1, buckets=10000, seed=2024, min_words=20, percent=10):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t, lo, hi)[1])
    s, t = counts(x for _, x in docs), counts(target)
    sa, ta = float(sum(s.values())), float(sum(t.values()))
    out, order = [], []
    for i, (d, text) in enumerate(docs):
        w, f = brute_features(text, lo, hi)
        b = [zlib.crc32(x.encode()) % buckets for x in f]
        g = [math.floor(1000 * math.log((t[k] + 1.0) * (sa + buckets) / ((s[k] + 1.0) * (ta + buckets)))) for k in b]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
        if len(w) >= min_words:
            order.append(((-score, d is None, d or 0), i))
    for rank, (_, i) in enumerate(sorted(order)[:percent * len(order) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 3)])
def test_resample_against_brute_force(spark, monkeypatch, lo, hi):
    random.seed(lo + 10 * hi)
    vocab = ["the", "Of", "größe", "x1", "中文", "ÇA", "a", "code", "math"] + [f"w{i}" for i in range(30)]
    docs = [(random.randrange(-5, 40) if random.random() < 0.9 else None, " ".join(random.choices(vocab, k=random.randrange(60)))) for _ in range(150)]
    docs += [(None, None), (3, ""), (4, "--- !!")]
    target = ["code math the w1 w2", None, "math, math; CODE"]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(x,) for x in target], "text string")
    want = brute_draw(docs, target, lo, hi, min_words=10, percent=30)
    got = resample.draw(a, b, n_min=lo, n_max=hi, min_words=10, percent=30)
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(map(key, rows(got)), key=repr) == sorted(map(key, want), key=repr)
    # rows equal in score and id may take each other's ranks
    assert sorted(((r[4], r[3], r[0]) for r in rows(got) if r[4]), key=repr) == sorted(((r[4], r[3], r[0]) for r in want if r[4]), key=repr)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)
    monkeypatch.setattr(resample, "CACHE", 5)
    random.seed(2)
    for lo, hi in [(1, 1), (1, 3), (2, 2), (3, 4)]:
        find = resample.Buckets(lo, hi, 997)
        for _ in range(60):
            text = "".join(random.choices("ab C1é-. ", k=random.randrange(80)))
            want = Counter(zlib.crc32(f.encode()) % 997 for f in brute_features(text, lo, hi)[1])
            assert Counter(x for at in find.arrays(text.encode()) for x in at.tolist()) == want


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "null ids", "text ids", "one"])
def test_radix_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(resample, "BLOCK", 64)
    monkeypatch.setattr(resample, "DIGIT", 4)
    random.seed(9)
    n = 1 if kind == "one" else 500
    big = 2 ** 63 - 1
    ids = {"plain": lambda: random.randrange(10 ** 6), "ties": lambda: random.randrange(3), "wide": lambda: random.choice([-big - 1, big, random.randrange(-big, big), 0]),
           "null ids": lambda: random.choice([None, None, 5, -7, 8]), "text ids": lambda: random.choice([None, "b", "a", "", "é", "zz"]), "one": lambda: None}[kind]
    data = [(ids(), random.choice([-50, -50, -50, 3, 999, 12345]), i) for i in range(n)]
    id_type = "string" if kind == "text ids" else "long"
    df = stored(spark.createDataFrame(data, f"doc_id {id_type}, score long, other int").repartition(6), "t-radix")
    got = resample.ranked(df).collect()
    assert sorted(r.place for r in got) == list(range(n)) and sorted(r.other for r in got) == list(range(n))
    want = sorted(data, key=lambda r: (-r[1], r[0] is None, r[0].encode() if isinstance(r[0], str) else r[0] or 0))
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.place)] == [r[:2] for r in want]


def test_resample_odd(odd, none, spark):
    b = spark.createDataFrame([("lorem ipsum",)], "text string")
    got = {(r.doc_id, r.n_features): r for r in resample.draw(odd, b, min_words=1, percent=50).collect()}
    assert got[1, 0].weight == got[2, 0].weight == got[3, 0].weight == 0 and got[5, 200_000].weight < 0
    assert sum(r.rank is not None for r in got.values()) in (3, 4)         # 4 of 9 rows with words, one of them repeated
    drawn = resample.draw(odd, b, min_words=1, percent=100)
    assert drawn.where("rank is not null").count() == 9
    assert resample.sample(odd, drawn).columns == odd.columns
    assert resample.draw(none, b).count() == 0
    assert resample.draw(odd, b.where("false")).count() == 12


# ---------------------------------------------------------------- languages without a cap
def test_every_language_is_learned_and_has_its_reference(spark, monkeypatch):
    from tierlens.llm import langid, quality
    langs = [f"l{i:02d}" for i in range(70)]
    docs = [(10 * i + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in range(k, k + 40)), x) for i, x in enumerate(langs) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "EPOCHS", 1)
    assert langid.fit(df).langs == langs
    monkeypatch.setattr(quality, "REF_WORDS", 10)
    assert {r["lang"] for r in quality.references(quality.features(df))} == set(langs)
    monkeypatch.setattr(langid, "MAX_LANGS", 69)
    monkeypatch.setattr(quality, "MAX_LANGS", 69)
    for run in (lambda: langid.fit(df), lambda: quality.references(quality.features(df))):
        with pytest.raises(ValueError, match="languages"):
            run()


def test_bpe_round_trip_is_decode_after_encode(odd, none, spark):
    import public_tokenizers

    from tierlens.llm import bpe
    path = public_tokenizers.path("word_bpe_49k.json")
    key = lambda df: sorted(((r.doc_id, bytes(r.ids), r.text) for r in df.collect()), key=repr)
    assert key(bpe.round_trip(odd, path)) == key(bpe.decode(bpe.encode(odd, path), path))
    assert bpe.round_trip(none, path).count() == 0


def test_huffman_splits_the_parts_of_many_texts_together(monkeypatch):
    from tierlens.llm import huffman
    from tierlens.llm.queries import vocabulary

    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        lib = huffman.LibraryIds(f.read())
    random.seed(7)
    words = ["".join(random.choices("abcdeéñ", k=random.randint(3, 9))) + random.choice(["", ".", ",\nNext", "'ll", "###", "42"]) for _ in range(3000)]
    texts = [" ".join(random.choices(words, k=200)) for _ in range(60)]
    texts += [None, "", " ", "a ", " a", "a  b", "a\n b", "a\n", " \nfoo x", "don't 漢字 語x 12", "😀a 漢 é", "<|endoftext|> a", "a　 b", "a　b c"]
    asked, splits, split = [], [], huffman.pattern
    learn, lib._word_ids = lib._word_ids, lambda ws: asked.extend(ws) or learn(ws)
    monkeypatch.setattr(huffman, "pattern", lambda *a: splits.append(a) or split(*a))
    got = lib.encode(texts)
    assert got == [np.array(lib.lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(asked) == len(set(asked))
    assert len(splits) < 100  # of 3000 parts


def test_huffman_splits_bytes_as_the_library_does():
    from types import SimpleNamespace

    import pyarrow as pa

    from tierlens.llm import huffman
    from tierlens.llm.queries import vocabulary

    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    lib = huffman.library(spec)
    lib.words = huffman.Recent(huffman.CACHE_CHUNKS)
    random.seed(11)
    some = ["'"] * 4 + [*"strevmldST   \n\t\x0b\x1c\x85\xa0\u3000\u200bé漢½²٣1#-._😀𐐀\x00", "'ll", "'re'", "n't", "'LL"]
    texts = [*["".join(random.choices(some, k=random.choice([0, 1, 2, 5, 40]))) for _ in range(3000)], "it'", "s", "x'l", "l", "y ", " z\n", "\n w", None]
    want = [lib.lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole, lib.lib = lib.lib, SimpleNamespace()  # no text without a special string goes through it whole
    try:
        assert [np.frombuffer(x, "<u4").tolist() for x in lib.encode(texts)] == want
        flat, end = lib.ids(pa.array(texts)[5:-2])
        assert [flat[a:b].tolist() for a, b in zip(end, end[1:])] == want[5:-2]
        asked = []
        learn, lib._word_ids = lib._word_ids, lambda ws: asked.extend(ws) or learn(ws)
        again = huffman.library(spec)  # as the next task of this worker
        assert [np.frombuffer(x, "<u4").tolist() for x in again.encode(texts)] == want and not asked
    finally:
        huffman.library.cache_clear()
    assert whole.encode("a").ids


def test_jaccard_prefixes_are_stored_once_and_hub_blocks_keep_all_links(spark, monkeypatch):
    from tierlens.llm import jaccard

    random.seed(11)
    docs = []
    for c in range(12):
        base = [f"w{random.randrange(10 ** 6)}" for _ in range(60 + 20 * c)]
        for k in range(14):
            near = list(base)
            for at in random.sample(range(len(base)), random.randint(0, max(1, len(base) // 60))):
                near[at] = f"x{c}y{k}z{at}"
            docs.append((c * 100 + k, " ".join(near)))
    docs += [(5000 + k, docs[k][1]) for k in range(40)] + [(6000, None), (6001, "")]
    kept, store = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: kept.append(df.schema) or store(df, name))
    monkeypatch.setattr(jaccard, "ROWS", 50)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=4).collect()}
    assert sum(f.dataType.simpleString() == "array<bigint>" for s in kept for f in s) == 1
    sets = {i: {tuple(t.split()[a:a + 4]) for a in range(len(t.split()) - 3)} for i, t in docs if t}
    low = {i: i for i, _ in docs}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    assert got == {i: top(i) for i, _ in docs}
