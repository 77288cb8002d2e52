"""Quality rules against plain Python and against SQL."""
import math
import re
from collections import Counter

import duckdb

from seqloom.llm import op4_quality as op

SP = r"[\x20\x09-\x0d]+"


def plain(text):
    t = text or ""
    w = [x for x in re.split(SP, t) if x]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_measures(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a b c a b", "a a a a", "x\ny\nx\n\n \n", "é ü #*$ <b>\U0001f600 \x0bq\x1cz", "w " * 20000, "a b c d a b c e b c d " * 30, "one\r\ntwo\r\none\r\n"]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "id long, text string, lang string")
    for r in op.judged(df).collect():
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(texts[r["id"]]), texts[r["id"]]
    assert op.judged(df.limit(0)).collect() == []


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    got = spark.range(1).select(op.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_sql_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(op.SQL).fetchall())
    rows = op.query(spark, sf).collect()
    assert sorted(map(tuple, rows)) == want
    good = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id").collect()}
    judged = [r for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in judged) >= 0.99 * len(judged)
    assert all(r["kept"] for r in judged if r["n_words"] >= op.MIN_WORD_WORDS)
    bad = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
    judged = [r for r in rows if r["doc_id"] in bad and not r["base_failed"] and r["n_words"] >= op.MIN_WORD_WORDS]
    assert judged and sum(r["kept"] for r in judged) <= 0.05 * len(judged)
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 10


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame([(1, "w%d " * 60 % tuple(range(60)), "en", "s", "clash"), (2, None, None, None, "x")], "doc_id long, text string, lang string, source string, n_words string")
    out = op.stage(spark, df, "")
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]



def test_every_language_has_a_reference(spark, monkeypatch):
    monkeypatch.setattr(op, "MIN_REFERENCE", 10)
    df = spark.createDataFrame([(i, f"the of and to in is it on as at word{i}", f"l{i}") for i in range(1005)], "id long, text string, lang string")
    assert op.references(df).count() == 1005
