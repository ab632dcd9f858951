import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tierlens.llm import langid, secrets
from tierlens.llm.queries import ORACLE, QUERIES, held_out
from tools.oracle_check import rows_of

from ..conftest import SF_SMALL
from . import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], True) == rows_of(cols, cur.fetchall(), True)


def test_query_of_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_against_brute_force(spark):
    """The network's verdicts are taken as given; every other stage is done in plain Python."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    net = langid.fit(docs.where(~held_out()))
    ok = {r.doc_id for r in langid.predict(docs, net).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    kept = [(d, t) for d, t in docs.select("doc_id", "text").collect() if d in ok]
    _, low = brute.components(kept)
    kept = [x for x, c in zip(kept, low) if x[0] == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    known = {tuple(w[i:i + 13]) for _, t in items for w in [brute.words13(t)] for i in range(max(1, len(w) - 12))}

    def clean(text):
        w = brute.words13(text)
        hit = {k for i in range(len(w) - 12) if tuple(w[i:i + 13]) in known for k in range(i, i + 13)}
        return not (hit and 20 * len(hit) >= len(w))
    kept = [x for x in kept if clean(x[1])]
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan(docs).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: lib.encode(brute.redacted(t, spans[d]), add_special_tokens=False).ids for d, t in kept}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == want
