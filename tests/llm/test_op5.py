"""BagMinHash near duplicates against brute force over all pairs."""
import random
import re
from collections import Counter

import numpy as np

from seqloom.llm import op5_neardup as op


def bag(text):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def classes(rows):
    bags = {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        bags.setdefault(i, bag(t))
    up = {i: i for i in bags}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if jaccard(bags[a], bags[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def corpus(n=160, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(30, 200))]
            if r.random() < 0.2:
                w = w + w[:20] * 6  # shingles of a higher weight
            base.append(w)
        rows.append((i * 7, " ".join(w)))
    rows += [(5001, None), (5002, ""), (5003, "..."), (5004, "one two"), (5005, "One, two!"), (5006, "x"), (5007, "ab " * 30000), (5008, "ab " * 30001)]
    return rows + rows[:3]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, cls int")
    got = {r["id"]: r["class_id"] for r in op.near_duplicates(df).collect()}
    assert got == classes(rows)


def test_blocks_find_links_that_the_star_misses(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 5000)
    rows = corpus(120, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in op.near_duplicates(df).collect()} == classes(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(df).collect() == []


def test_signature_is_unbiased():
    r = random.Random(1)
    errors = []
    for k in range(40):
        n = r.randint(20, 200)
        a = {x: r.choice([1, 1, 1, 2, 5, 40]) for x in range(n)}
        b = {x: (w if r.random() < 0.7 else r.choice([1, 3, 9])) for x, w in a.items()}
        b.update({x: 2 for x in range(n, n + r.randint(0, n // 2))})
        hs = op.mix(np.arange(n * 2, dtype=np.uint64) + np.uint64(k * 100003))
        sig = [op.signatures(hs[list(d)], np.array(list(d.values())), np.array([0, len(d)]), 512)[0] for d in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - jaccard(Counter(a), Counter(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_stage_keeps_documents_with_odd_ids(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, text("n")), (None, a), (4, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    out = op.stage(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert got == sorted([(3, a), (5, b), (9, c), (0, text("n")), (0, a), (4, "")])
    plain = df.filter("doc_id in (3, 7, 9)")
    assert sorted(r["doc_id"] for r in op.stage(spark, plain, "").collect()) == [3, 7, 9]


def test_an_id_with_several_texts_is_one_of_them(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    a, b = text("a"), text("b")
    df = spark.createDataFrame([(5, a), (5, b), (5, b), (6, b), (7, a)], "doc_id long, text string")
    for part in (1, 4):
        got = {r["id"]: r["class_id"] for r in op.near_duplicates(df.repartition(part)).collect()}
        assert got in ({5: 5, 6: 5, 7: 7}, {5: 5, 6: 6, 7: 5})
    assert got == {r["id"]: r["class_id"] for r in op.near_duplicates(df.orderBy("text")).collect()}


def brute_links(rows, queries):
    """(query, id, similarity) of all pairs at the threshold, by an inverted index of shingles."""
    held = {i: bag(t) for i, t in rows}
    where = {}
    for i, own in held.items():
        for s in own:
            where.setdefault(s, []).append(i)
    out = []
    for q in queries:
        if held[q]:
            near = Counter(i for s in held[q] for i in where[s])
            out += [(q, i) for i in near if i != q and jaccard(held[q], held[i]) >= op.THRESHOLD]
    return out


def test_no_link_of_the_table_is_missed(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in op.query(spark, "/root/testdata/sf0.01").collect()}
    links = brute_links(rows, [i for i, _ in rows])
    assert len(links) > 50
    assert sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)
