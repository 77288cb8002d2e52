"""The pipeline's stages on small data, each checked on its own input."""
import random
from collections import Counter

import corpus_pipeline
from seqloom.llm import op1_decontam, op4_quality, op5_neardup, queries


def test_stage_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "token_ids":
            assert after.columns == columns
        ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
        if name == "quality":
            verdicts = op4_quality.judged(before.selectExpr("doc_id as id", "text", "lang")).collect()
            assert ids(after) == {r["id"] for r in verdicts if r["kept"]}
        elif name == "near_duplicates":
            classes = {r["id"]: r["class_id"] for r in op5_neardup.near_duplicates(before).collect()}
            assert ids(after) == set(classes.values()) and after.count() == len(set(classes.values()))
        elif name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
            hit = {r["doc_id"] for r in before.collect() if any(b["text"] in r["text"] for b in bench)}
            assert not ids(after) & hit
            found = {r["id"] for r in op1_decontam.passages(before.selectExpr("doc_id as id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")).collect()}
            assert ids(after) == ids(before) - found
        elif name == "token_ids":
            assert after.count() == before.count()
        before = after


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_odd_rows(spark, tmp_path):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(80))
    a, b, c = text(), text(), text()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, b, "en", "s"), (2, None, None, None), (3, "", "en", None), (None, c, "en", "t"), (None, f"{bench} {text()}", None, "t")]
    df = spark.createDataFrame([(*x, k, "z") for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, kept int, id string")
    want = {
        "quality": [(1, a), (1, a), (1, b), (None, c), (None, rows[6][1])],
        "near_duplicates": [(1, a), (1, b), (None, c), (None, rows[6][1])],
        "decontamination": [(1, a), (1, b), (None, c)],
        "mixing": [(1, a), (1, b), (None, c)],
    }
    plain = lambda x: sorted(x, key=lambda y: (y[0] or 0, y[1]))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0, name
        out = stage(spark, df, "/root/testdata/sf0.001")
        if name in want:
            out.write.parquet(f"{tmp_path}/{name}")
            df = spark.read.parquet(f"{tmp_path}/{name}")
            assert out.schema.names == ["doc_id", "text", "lang", "source", "kept", "id"]
            got = [(r["doc_id"], r["text"]) for r in df.collect()]
            if name == "mixing":  # a source's budget may leave one of its documents out
                assert set(got) <= set(want[name]) and (None, c) in got and len({x[0] for x in got}) == 2
            else:
                assert plain(got) == plain(want[name]), name
        else:
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in df.collect())


def test_workers_keep_nothing_of_other_stages():
    """Idle workers held what earlier stages had freed, and the token cache, beside the JVM of their executor."""
    import numpy as np

    from seqloom.llm import common
    from seqloom.llm.op10_tokenids import _encoders

    anon = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1])

    def run(batches):
        for b in batches:
            held = [np.ones(10_000) for _ in range(2_000)]  # 160 MB that malloc keeps while the last lives
            last = held.pop()
            del held
            yield b + int(last[0])

    common.tidy("")
    assert common.KEPT["encoders"] is _encoders
    _encoders["test"] = None
    before = anon()
    assert list(common.lean(run, "encoders")([1, 2])) == [2, 3] and "test" in _encoders
    assert list(common.lean(run)([1, 2])) == [2, 3] and "test" not in _encoders
    assert anon() - before < 50_000
