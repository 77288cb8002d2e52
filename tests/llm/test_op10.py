"""Token-id shards: exact round trips, and ids equal to the library's for whole texts."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import op10_tokenids as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for top in (3, 300, 70_000, 20_000_000):
        lengths = r.integers(1, 50, 40)
        ids = r.integers(0, top, lengths.sum())
        s = op.Shard(op.shard_bytes(np.arange(40), lengths, ids))
        assert (s.ids() == ids).all()
        ends = np.cumsum(lengths)
        for k in range(40):
            assert (s.document(k) == ids[ends[k] - lengths[k]: ends[k]]).all()


def test_pieces_equal_whole_texts():
    lib = Tokenizer.from_file(PATH)
    r = random.Random(2)
    bits = ["a", "Ab", " ", "  ", "\n", "\t", " \n", " ", "　", "\x1c", "\x85", "'s", "'ll", "12", ".", ",,", "é", "ß", "日", "\U0001f600", "<|endoftext|>", "​", "word", "wörter.", "X,", "?!", "\nNext.", "...", "'S"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    enc = op.Encoder(PATH)
    texts += ["a × b", "x÷y", "ɐ ɏ", "Ω", "a\u0301", "ab " * 3000, "x" * 300 + " " + "y" * 65, None]
    for t, b in zip(texts, enc.encode(pa.array(texts), 2)):
        t = t or ""
        assert list(np.frombuffer(b, enc.kind)) == lib.encode(t, add_special_tokens=False).ids + [2], repr(t)


def check(spark, df, monkeypatch=None):
    lib = Tokenizer.from_file(PATH)
    want, at = [], 0
    rows = [(r["doc_id"], np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")) for r in df.collect()]
    rows = [(i, x, zlib.crc32(x.astype("<u2").tobytes())) for i, x in rows]
    for i, x, _ in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[2])):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = [tuple(r) for r in op.encode_and_read(df).collect()]
    assert sorted(got, key=lambda v: v[1]) == want


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE_DOCS", 30)
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_rows(spark):
    rows = [(5, "b c", 1), (1, None, 2), (2, "", 3), (2, "x y", 4), (2, "x y", 4), (None, "no id", 5), (-7, "z " * 50000, 6)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, range int"))


def test_empty_table(spark):
    assert op.encode_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_keeps_the_order_of_files(spark, tmp_path):
    rows = [((k * 37) % 101, f"text {k}") for k in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions(op.F.desc("text"))
    df.write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/docs")
    out = {r["doc_id"]: r["start"] for r in op.stage(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()}
    want = [i for i, _ in sorted(rows, key=lambda r: r[1], reverse=True)]
    assert sorted(out, key=out.get) == want
    loose = {r["doc_id"]: r["start"] for r in op.stage(spark, df, "").collect()}
    assert sorted(loose, key=loose.get) == want


def test_pieces_that_share_a_hash(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    whole = op.plain_pieces

    def weak(*args):
        plain, h, *rest = whole(*args)
        return plain, h % np.uint64(50) + np.uint64(1), *rest

    monkeypatch.setattr(op, "plain_pieces", weak)
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "word", "of", f"w{r.randrange(300)}"]) for _ in range(r.randint(0, 9))) + "\n" * r.randint(0, 1) for _ in range(400)]
    enc = op.Encoder(PATH)
    for _ in range(2):
        for t, b in zip(texts, enc.encode(pa.array(texts), 2)):
            assert list(np.frombuffer(b, enc.kind)) == lib.encode(t, add_special_tokens=False).ids + [2], repr(t)
