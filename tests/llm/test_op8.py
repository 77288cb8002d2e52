"""Prefix token counts against the library, for whole texts and for every prefix."""
import random

import public_tokenizers
import pytest
import sentencepiece

from seqloom.llm import op8_tokencount as op

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a  b", "x\n\ny\t z ", "<s>hi</s><unk>", "▁a ▁▁b", "日本語 テスト", "ﬁ Ａ　x", "\U0001f600\U0001f600 ok", "aaaaaaaaaaaaaaaa" * 20, "  \n  ", "é\u0000z", "don't 12345 3.14", "   lead and trail   "]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_prefix(sp):
    c = op.PrefixCounter(MODEL)
    r = random.Random(4)
    alphabet = "abcdeéèßñ  .,\n-tionher日"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(150)]
    for t in texts:
        idx = c.index(t)
        want = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert [idx.count(k) for k in range(len(t) + 1)] == want, t
        assert c.count(t) == want[-1]
        for budget in (0, 1, 2, 5, 20, 1000):
            assert idx.longest(budget) == max(k for k in range(len(t) + 1) if want[k] <= budget)


def test_documents(spark, sp):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in op.query(spark, "/root/testdata/sf0.001").collect()}
    for r in df.collect():
        n = len(sp.encode(r["text"]))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(r["text"].encode()), n, n > 4096)


def test_nulls_and_long_texts(spark, sp):
    c = op.PrefixCounter(MODEL, cache=10)
    long = "qwzx" * 20000
    assert c.count(long) == len(sp.encode(long))
    df = spark.createDataFrame([(7, 1, None), (7, 2, ""), (7, 2, ""), (7, None, "a b")], "n_tokens int, id long, text string")
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in op.token_counts(df, MODEL).collect()) == [(0, len(sp.encode("a b"))), (1, 0), (2, 0), (2, 0)]
    assert op.token_counts(df.limit(0), MODEL).collect() == []
