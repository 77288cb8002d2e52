"""Mixing: the exponent, the budget of each source, whole epochs, and odd rows."""
import math
from collections import Counter, defaultdict

from seqloom.llm import op3_mixing as op


def table(spark):
    rows, n = [], 0
    for s, k in (("big", 900), ("mid", 90), ("small", 20), (None, 12)):
        for i in range(k):
            rows.append((n, s, "w " * (1 + (n * 7919) % 40), 0))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens int"), rows


def weights(rows, alpha):
    t = defaultdict(int)
    for _, s, x, _ in rows:
        t[s or ""] += len(x.split())
    total = sum(t.values())
    z = sum((v / total) ** alpha for v in t.values())
    return {s: (v / total) ** alpha / z for s, v in t.items()}, t, total


def test_weights_and_budgets(spark):
    df, rows = table(spark)
    src = op.counted(df).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n")
    _, t, total = weights(rows, 1)
    for share, limit in ((0.8, 1e9), (0.95, 1e9), (0.95, 3.0), (0.1, 4.0)):
        alpha = op.exponent(src, total, share, limit)
        w, _, _ = weights(rows, alpha)
        h = -sum(x * math.log2(x) for x in w.values())
        repeat = max(w[s] * total / t[s] for s in t)
        assert repeat <= limit * 1.0001
        if limit > 100:
            assert abs(h - share * 2) < 1e-6
        elif share == 0.1:
            assert alpha == 1.0
        else:
            assert abs(repeat - limit) < 1e-3
        got = op.mixed(df, None, share, limit).collect()
        used, seen = Counter(), defaultdict(Counter)
        for r in got:
            used[r["source"]] += r["n_tokens"]
            seen[r["source"]][r["doc_id"]] += 1
            assert 0 <= r["mix_at"] <= 1
        for s in t:
            assert -1e-6 <= w[s] * total - used[s] <= 41, (s, share)
            counts = set(seen[s].values())
            assert max(counts) - min(counts) <= 1  # whole epochs
        assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "b", "x y"), (3, "b", "x y"), (None, None, "z")], "doc_id long, source string, text string")
    got = op.mixed(df, None, 0.0, 4.0).collect()
    assert Counter(r["doc_id"] for r in got) == {3: 2, None: 1}
    assert op.mixed(df.limit(0)).collect() == []
    assert op.mixed(df.filter("doc_id < 3")).collect() == []


def test_stage_keeps_columns(spark):
    df, _ = table(spark)
    out = op.stage(spark, df, "")
    assert out.columns == df.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert copies == Counter(r["doc_id"] for r in op.mixed(df).collect())


def test_the_permutation(spark):
    """Which documents come, and in what order, by a plain loop over blocks and documents."""
    from pyspark.sql import functions as F

    df, rows = table(spark)
    src = op.counted(df).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n")
    w, t, total = weights(rows, op.exponent(src, total_of(rows), 0.9, 1e9))
    got = defaultdict(list)
    for r in op.mixed(df, None, 0.9, 1e9).collect():
        got[r["source"]].append((r["mix_at"], r["epoch"], r["doc_id"]))
    docs = defaultdict(list)
    for e in range(30):
        inner = F.xxhash64(F.lit(op.SEED + 1), F.lit(e), "mark")
        block = F.xxhash64(F.lit(op.SEED), "source", F.lit(e), "block")
        if e and all(e > w[s] * total / t[s] for s in t):
            break
        for r in op.counted(df).select("source", "doc_id", "n_tokens", "block", block.alias("b"), inner.alias("i")).collect():
            docs[r["source"], e].append((r["b"], r["block"], r["i"], r["doc_id"], r["n_tokens"]))
    for s in t:
        want, left = [], int(w[s] * total + 1e-6)
        for e in range(30):
            own = sorted(docs[s, e])
            size = sum(x[4] for x in own)
            if left >= size:
                want += [(e, x[3]) for x in own]
                left -= size
                continue
            for k, x in enumerate(own):
                block = [y for y in own if y[1] == x[1]]
                before = sum(y[4] for y in own[:k])
                start = sum(y[4] for y in own if (y[0], y[1]) < (x[0], x[1]))
                if start < left and before + x[4] <= left:
                    want.append((e, x[3]))
            break
        assert sorted((e, i) for _, e, i in got[s]) == sorted(want), s
        order = [(e, i) for _, e, i in sorted(got[s])]
        blocks = {(e, x[3]): (e, x[0], x[1]) for e in range(30) for x in docs[s, e]}
        assert [blocks[x] for x in order] == sorted(blocks[x] for x in order), s


def total_of(rows):
    return sum(len(x.split()) for _, _, x, _ in rows)


def test_stage_keeps_rows_of_any_id_in_order(spark, tmp_path):
    rows = [(None if k % 5 == 0 else k % 40, "ab"[k % 2], f"word{k} " * 20, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens int")
    op.stage(spark, df, "").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").select("n_tokens", "source", "_metadata.file_name", "_metadata.row_index").collect()
    assert {r["n_tokens"] for r in out} == set(range(200))
    source = [r["source"] for r in sorted(out, key=lambda r: (r["file_name"], r["row_index"]))]
    assert 30 <= source[:100].count("a") <= 70  # interleaved
