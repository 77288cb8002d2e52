"""CGK decontamination against brute-force edit distances."""
import random
import re

import numpy as np

from seqloom.llm import op1_decontam as op


def words(t):
    return [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]


def least(item, text):
    """Plain semi-global edit distance."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def data(seed=5):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(150)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(15, 59)))) for i in range(25)] + [(90, "of the"), (91, None), (92, "")]
    docs = []
    for d in range(200):
        body = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if r.random() < 0.6:
            w = words(r.choice(items[:25])[1])
            for _ in range(r.randint(0, int(0.25 * len(w)))):
                p = r.randrange(len(w))
                kind = r.random()
                if kind < 0.4:
                    w[p] = r.choice(vocab)
                elif kind < 0.7:
                    w.insert(p, r.choice(vocab))
                else:
                    del w[p]
            at = r.randint(0, len(body))
            body[at:at] = w
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "..,"), (903, "x " * 40000 + items[0][1])]
    return docs + docs[:2], items


def test_recall_and_exactness(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "id long, text string, item_id string").select("id", "text")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): r["distance"] for r in op.passages(d, b).collect()}
    want = {}
    for i, t in dict(docs).items():
        for k, s in items[:25]:
            w = words(s)
            if i != 903 and (x := least(w, words(t))) <= op.allowed(len(w)):
                want[(i, k)] = x
    want[(903, 0)] = 0
    assert set(got) <= set(want)
    assert all(got[p] == want[p] for p in got)
    assert len(got) >= 0.99 * len(want)
    near = {p for p, x in want.items() if x <= 0.1 * len(words(dict(items)[p[1]]))}
    assert near <= set(got)


def test_edit_distance_bounds():
    r = random.Random(2)
    for _ in range(60):
        a = np.array([r.randrange(6) for _ in range(r.randint(1, 12))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randint(0, 20))], np.uint64)
        d, s, e = op.edit_distance(a, b)
        assert d == least(list(a), list(b)) and s <= e
        full = list(range(len(b[s:e]) + 1))
        for i, w in enumerate(a):
            new = [i + 1]
            for j, x in enumerate(b[s:e]):
                new.append(min(full[j] + (x != w), full[j + 1] + 1, new[j] + 1))
            full = new
        assert full[-1] == d


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "id long, text string")
    assert op.passages(none, items).collect() == []
    assert op.passages(some, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert [tuple(x) for x in op.passages(some, items).collect()] == [(1, 1, 0, 7, 0, 7)]


def test_long_items_by_kind_of_edit():
    r = random.Random(8)
    kinds = {"change": lambda w, p: w.__setitem__(p, f"n{r.randrange(10**9)}"), "insert": lambda w, p: w.insert(p, f"n{r.randrange(10**9)}"), "delete": lambda w, p: w.__delitem__(p)}
    sizes = [5, 9, 14, 49, 100, 124, 200, 400]
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate(sizes)]
    block = op.Items(list(range(len(items))), [" ".join(w) for w in items])
    for kind in [*kinds, "mixed"]:
        docs = []
        for w in items:
            w, places = list(w), sorted(r.sample(range(len(w)), op.allowed(len(w))), reverse=True)
            for p in places:
                kinds[r.choice(list(kinds)) if kind == "mixed" else kind](w, p)
            docs.append(" ".join([f"b{r.randrange(10**9)}" for _ in range(r.randint(0, 90))] + w + ["end"] * r.randint(0, 9)))
        _, _, data, offs = next(op.text_chunks(op.pa.array(docs)))
        h, _, _, first = op.word_hashes(data, offs)
        got = {t: (k, d) for t, k, d, *_ in block.match(h, first)}
        for k, (w, t) in enumerate(zip(items, docs)):
            assert got.get(k) == (k, least(w, words(t))), (kind, len(w))


def test_short_items_stand_word_for_word(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "Beta, gamma delta epsilon"), (4, "..."), (None, "alpha"), (5, "a b c d e")]
    docs = [(1, "x alpha y alpha"), (2, "x beta gamma delta"), (3, "beta x gamma; beta gamma delta, epsilon."), (4, "beta"), (5, "alphabet gamma"), (6, "a b c x d e")]
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "id long, text string, item_id string, distance int")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, id string")
    got = {(r["id"], r["item_id"]): (r["distance"], r["start"], r["stop"]) for r in op.passages(d, b).collect()}
    assert got == {(1, 1): (0, 1, 2), (2, 2): (0, 1, 3), (3, 2): (0, 3, 5), (3, 3): (0, 3, 7), (6, 5): (1, 0, 6)}


def test_scripts_without_spaces(spark):
    r = random.Random(4)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    kana, wide = "".join(chr(r.randrange(0x3041, 0x3096)) for _ in range(40)), "".join(chr(r.randrange(0x20000, 0x2A6D0)) for _ in range(25))
    thai = "".join(chr(r.randrange(0x0E01, 0x0E2E)) for _ in range(30))
    a = han(60)
    items = [(1, a[:30] + "。" + a[30:]), (2, kana), (3, wide), (4, "三四"), (5, thai)]
    near = list(a)
    for p in r.sample(range(60), 12):
        near[p] = "龍"
    docs = [(1, han(80) + a + han(9)), (2, "text " + kana + " text"), (3, wide[1:] + "x"), (4, han(200)), (5, "一二三四五"), (6, "".join(near)), (7, "é" + thai), (8, a[:30])]
    d, b = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): r["distance"] for r in op.passages(d, b).collect()}
    assert {p for p in got if p[1] != 4 or p[0] == 5} == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 1), (7, 5)}
    assert got[1, 1] == got[2, 2] == got[7, 5] == 0 and got[3, 3] == 1 and 9 <= got[6, 1] <= 12


def test_blocks_of_items_and_rows_without_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(op, "BLOCK_ROWS", 2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(11)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k % 3 or None, f"x {t} y", "s", k) for k, t in items] + [(None, "fine text", None, 50), (7, None, "s", 51), (7, "", "s", 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, distance int")
    out = op.stage(spark, df, str(tmp_path))
    assert out.schema == df.schema
    assert sorted(r["distance"] for r in out.collect()) == [50, 51, 52]
    found = op.passages(df.selectExpr("distance as id", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["id"], r["item_id"]) for r in found) == [(k, k) for k in range(11)]
