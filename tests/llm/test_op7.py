"""PPM code lengths against a plain implementation, and held-out accuracy."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from seqloom.llm import op7_langid as op


def plain_bits(samples, text, order):
    count = defaultdict(Counter)
    for t in samples:
        for k in range(order + 1):
            for i in range(k, len(t)):
                count[t[i - k:i]][t[i]] += 1
    total = 0.0
    for i, s in enumerate(text):
        for k in range(min(order, i), -1, -1):
            c = count.get(text[i - k:i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if s in c:
                total -= math.log2(c[s] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths():
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": [b"der hut und die katze", "größe".encode()]}
    texts = [b"the hut", b"", b"\xff\xfe", "größte katze sat".encode(), b"q", b"that that the the"]
    for order in (1, 2, 3):
        m = op.Ppm({k: op.gram_counts(v, order) for k, v in samples.items()}, order).build()
        got = m.bits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
        want = [[plain_bits(samples[x], t, order) for x in m.langs] for t in texts]
        assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, "der hut", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (6, "the " * 50000, None), (1, "the cat sat", "en"), (None, "hut", "de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = sorted(((r["id"] or 0, r["lang_pred"]) for r in op.identify(df.select("id", "text"), op.train(df)).collect()))
    assert len(got) == 8
    assert dict(got)[3] == dict(got)[4] == dict(got)[5] == "und"
    assert dict(got)[6] == "en"
    none = df.limit(0)
    assert op.identify(none.select("id", "text"), op.train(none)).collect() == []
    assert {r["lang_pred"] for r in op.identify(df.select("id", "text"), op.train(none)).collect()} == {"und"}


def test_language_of_long_texts_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_BYTES", 1000)
    rows = [(i, "some short text " * 5, "xa") for i in range(40)] + [(i, "zuviel langes " * 100, "xb") for i in range(40, 80)]
    assert op.train(spark.createDataFrame(rows, "id long, text string, lang string")).langs == ["xa", "xb"]


def test_many_languages(spark, monkeypatch):
    words = [f"{'bcdfgklmnprstvz'[k % 15]}{'aeiou'[k // 15 % 5]}{'bcdfgklmnprstvz'[k // 75]}" for k in range(205)]
    rows = [(k * 10 + i, f"{w} {w}{w} " * 6 + str(i), f"l{k:03d}") for k, w in enumerate(words) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    model = op.train(df)
    assert model.langs == sorted({r[2] for r in rows})
    monkeypatch.setattr(op, "BUNDLE", 1000)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in op.identify(df.select("id", "text"), model).collect()}
    assert {i: p for i, (p, _) in got.items()} == {r[0]: r[2] for r in rows}
    # tables by groups and all at once give the same
    whole = op.Ppm(model.counted).build()
    data, offs = op.np.frombuffer("".join(r[1] for r in rows).encode(), op.np.uint8), np.cumsum([0] + [len(r[1].encode()) for r in rows])
    assert np.allclose(model.bits([(data, offs)])[0], whole.bits(data, offs))


def test_the_smallest_hashes_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_DOCS", 5)
    rows = [(i, f"word{i} of text", "xa" if i % 3 else "xb") for i in range(3000)] + [(7, "again", "xa")] * 500
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    picked = []
    monkeypatch.setattr(op, "gram_counts", lambda texts, order: picked.append(sorted(t.decode() for t in texts)) or [])
    op.train(df)
    hashes = {r["id"]: r["h"] for r in df.filter(~op.held_out("id")).selectExpr("id", "xxhash64(id) h").distinct().collect()}
    first = lambda c: sorted(f"word{i} of text" for i in sorted((i for i in hashes if c(i)), key=hashes.get)[:5])
    assert picked == [first(lambda i: i % 3), first(lambda i: not i % 3)]


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en", "x", 0.5, True), (3, "der hut", "de", "y", 0.1, False)], "id long, text string, lang string, lang_pred string, score double, held_out boolean")
    out = op.identify(df, op.train(df))
    assert out.columns == ["id", "held_out", "lang_pred", "score"] and out.count() == 2
