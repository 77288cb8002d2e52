"""Clustering, index and search on small inputs and random graphs."""
import gzip
import random

import numpy as np
import pytest
from fixtures import CLUSTERS, FASTQ, LONG, QUERIES, SHIFTED, SMALL, frame, parse
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.config import ClusterOptions, IndexOptions, SearchOptions, SeedPolicy
from seqloom.errors import SeqError
from seqloom.functions import columns as C
from seqloom.functions import kernels as K
from seqloom.operators import candidates, cascade, cluster, search
from seqloom.operators.index import Index
from seqloom.operators.ranking import dense_index
from seqloom.sources import fasta
from seqloom.storage import scratch_dir


# ------------------------------------------------------------------ a sequential version

def sequential(seqs, o):
    """Greedy clustering in one loop: (cluster, rep, member) rows and counters."""
    raw = [s.encode() for _, s in seqs]
    groups, n_seeds = {}, 0
    for i, s in enumerate(raw):
        h, _, _ = K.seeds(np.frombuffer(s, np.uint8), np.array([0, len(s)]), o.kmer_size, o.seeds_per_seq, o.reduced)
        n_seeds += len(h)
        for x in h.tolist():
            groups.setdefault(x, set()).add(i)
    order = sorted(range(len(raw)), key=lambda i: (-len(raw[i]), i))
    near = [set() for _ in raw]
    for ids in groups.values():
        if not 2 <= len(ids) <= candidates.LARGEST:
            continue
        if len(ids) <= candidates.CLIQUE:
            for i in ids:
                near[i] |= ids - {i}
        else:
            lead = min(ids, key=lambda i: (-len(raw[i]), i))
            for i in ids - {lead}:
                near[lead].add(i)
                near[i].add(lead)
    th, f = o.thresholds, np.float32
    count = dict.fromkeys(cluster.COUNTERS, 0)
    count |= {"seeds_generated": n_seeds, "unique_kmers": len(groups)}

    def coverage(a, q, t, c):
        of_q, of_t = f(a) / f(max(q, 1)), f(a) / f(max(t, 1))
        return {1: of_t >= f(c), 2: of_q >= f(c), 3: f(max(t, 1)) / f(max(q, 1)) >= f(c)}.get(o.cov_mode, of_q >= f(c) and of_t >= f(c))

    def passes(r, c):
        q, t = len(raw[c]), len(raw[r])
        n = min(q, t)
        mm = K.mismatches(raw[r], raw[c])
        allowed = max(0, int(np.floor((f(1) - f(th.prefilter_identity)) * f(n))))
        if mm > allowed:
            count["hamming_rejected"] += 1
            return False
        if not coverage(n, q, t, th.final_coverage) or n == 0 or f(n - mm) / f(n) < f(th.prefilter_identity):
            count["ungapped_rejected"] += 1
            return False
        if not th.gapped:
            return True
        _, length, same = K.align_pair(raw[r], raw[c], o.scoring, o.min_identity)
        ok = length > 0 and f(same) / f(length) >= f(th.final_identity) and coverage(length, q, t, th.final_coverage)
        count["gapped_rejected"] += not ok
        return ok

    owner, reps = {}, []
    for r in order:
        if r in owner:
            continue
        owner[r] = len(reps)
        reps.append(r)
        count["total_posting_length_read"] += len(near[r])
        todo = sorted(c for c in near[r] if c not in owner)
        count["candidate_pairs_evaluated"] += len(todo)
        for c in todo:
            if passes(r, c):
                owner[c] = owner[r]
                count["assigned_pairs"] += 1
    return sorted((c, reps[c], i) for i, c in owner.items()), count


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_sequences(seed, n=70):
    r = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if base and r.random() < 0.7:
            s = list(r.choice(base))
            for _ in range(r.choice([0, 1, 2, 5, 9])):
                p = r.randrange(len(s))
                s[p:p + 1] = r.choice([["A"], ["W"], [], ["K", "L"], ["X"]])
        else:
            s = [r.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(r.randint(5, 80))]
            base.append(s)
        out.append((f"s{i}", "".join(s)))
    return out + [("empty", ""), ("n", "NNNNNNNNNNNNNN")]


@pytest.mark.parametrize("level", ["fast", "medium", "sensitive", "ultra"])
def test_clustering_equals_the_loop(spark, level):
    o = ClusterOptions(level=level, k=4, min_identity=0.8, cov_mode={"medium": 1, "ultra": 3}.get(level, 0))
    seqs = random_sequences(len(level))
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    want, count = sequential(seqs, o)
    assert rows(cluster.cluster(df, o)) == want
    got = cluster.counters(df, o).first().asDict()
    assert got == count


def test_star_groups_and_masked_groups(spark, monkeypatch):
    monkeypatch.setattr(candidates, "CLIQUE", 4)
    monkeypatch.setattr(candidates, "LARGEST", 9)
    o = ClusterOptions(k=4, min_identity=0.8)
    seqs = random_sequences(21, 90)
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    assert rows(cluster.cluster(df, o)) == sequential(seqs, o)[0]


@pytest.mark.parametrize("level", ["medium", "sensitive", "ultra"])
def test_large_groups_are_whole(spark, monkeypatch, level):
    """A group over 64 linked its longest member alone, and one over 1024 nothing."""
    r = random.Random(level)
    letters = lambda n: "".join(r.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(n))

    def near(s):  # shares no seed with ``s`` but those of its first 12 letters, which the group has in common
        s = list(s)
        for i in range(12, 60, 10):
            s[i] = "C" if s[i] in "FWY" else "W"
        return "".join(s)

    some, many = ["ACDEFGHIKLMA" + letters(48) for _ in range(80)], ["LKIHGFEDCAML" + letters(48) for _ in range(1000)]
    seqs = some + many + [near(s) for s in some[:10] + many[:30]] + many[40:44] + some[:4]
    r.shuffle(seqs)
    seqs = [(f"s{i}", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    o = ClusterOptions(level=level, kmers_per_seq=60)
    got = rows(cluster.cluster(df, o))
    assert 1 + max(c for c, _, _ in got) == 1080
    monkeypatch.setattr(candidates, "CLIQUE", len(seqs))
    monkeypatch.setattr(candidates, "LARGEST", len(seqs))
    assert got == sequential(seqs, o)[0]


@pytest.mark.parametrize("level, mode", [("medium", 0), ("sensitive", 1), ("ultra", 2), ("sensitive", 3)])
def test_few_partners_at_a_time(spark, monkeypatch, level, mode):
    """Partners in small lists and groups in many blocks give what the loop does, with copies of all kinds."""
    monkeypatch.setattr(cluster, "FEW", 1)
    monkeypatch.setattr(cluster, "GROWTH", 2)
    monkeypatch.setattr(candidates, "BLOCK", 1500)
    r = random.Random(mode)
    seqs = random_sequences(31 + mode, 90)
    unknown = ["ACDEFGHIKL" + "X" * n for n in (30, 30, 32)]  # don't pass with themselves
    large = "ACDEFGHIKL" * 401  # too long to be aligned with itself
    seqs += [("u", s) for s in unknown] + [("l", large)] * 3 + [("m", large[:3900])] * 2 + r.sample(seqs, 20)
    r.shuffle(seqs)
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    o = ClusterOptions(level=level, k=4, min_identity=0.8, cov_mode=mode)
    got = rows(cluster.cluster(df, o))
    monkeypatch.setattr(candidates, "CLIQUE", len(seqs))
    monkeypatch.setattr(candidates, "LARGEST", len(seqs))
    assert got == sequential(seqs, o)[0]


def test_small_fixture(spark):
    df = frame(spark, CLUSTERS)
    want = [(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 3, 3), (1, 3, 4)]
    assert rows(cluster.cluster(df, ClusterOptions())) == want
    assert rows(cluster.cluster(df, ClusterOptions(level="sensitive"))) == want
    assert cluster.counters(df, ClusterOptions()).first()["assigned_pairs"] == 3


def test_sensitive_finds_the_shift(spark):
    df = frame(spark, SHIFTED)
    sizes = {lv: cluster.cluster(df, ClusterOptions(k=5, level=lv)).select("cluster_id").distinct().count() for lv in ("fast", "medium", "sensitive", "ultra")}
    assert sizes["sensitive"] < sizes["fast"] and sizes["ultra"] <= sizes["fast"]


def test_same_result_for_any_partitioning(spark):
    seqs = random_sequences(5)
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    o = ClusterOptions(k=4, min_identity=0.8)
    first = rows(cluster.cluster(df, o))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(cluster.cluster(df.orderBy(F.rand(n)).repartition(n), o)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_independent_set_on_graphs(spark):
    r = random.Random(3)
    for n in (1, 12, 40):
        edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(3 * n)}) if n > 1 else []
        df = spark.createDataFrame(edges, "rep long, member long")
        want = []
        for v in sorted({x for e in edges for x in e}):
            if not any((u, v) in edges for u in want):
                want.append(v)
        assert sorted(x[0] for x in cluster.independent_set(df).collect()) == want


def test_dense_index(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = dense_index(df, [F.desc("x"), F.asc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1000))
    assert [(-r["x"], r["id"]) for r in got] == sorted((-r["x"], r["id"]) for r in got)
    assert dense_index(df.limit(0), [F.asc("id")], "n").collect() == []


def test_recall(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "cluster_id int, member_id long")
    b = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "cluster_id int, member_id long")
    assert tuple(cluster.pairwise_recall(a, b).first()) == (2, 1, 0.5)
    assert cluster.pairwise_recall(a, b.limit(0)).first()["recall"] == 1.0


# ------------------------------------------------------------------ scalar functions

def test_single_precision(spark):
    n = list(range(1, 5001, 7))
    got = spark.createDataFrame([(x,) for x in n], "n int").select("n", C.allowed_mismatches(0.9, F.col("n")).alias("a"), C.seed_weight(F.lit(1000), F.col("n")).alias("w")).collect()
    f = np.float32
    assert all(r["a"] == int(np.floor((f(1) - f(0.9)) * f(r["n"]))) for r in got)
    assert all(r["w"] == max(1, int(np.floor(np.float32(np.log(f(1001) / f(r["n"] + 1))) * f(1024) + f(0.5)))) for r in got if r["n"] < 1000)


# ------------------------------------------------------------------ sources and sinks

def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_fasta_reader(spark, tmp_path):
    text = "\n>a one \r\nac gt\r\nNN\n\n>empty\n>b\nMK\tT\n" + "".join(f">r{i}\n{'ACGT' * (i % 7)}\nTT\n" for i in range(300))
    p = write(tmp_path, "x.fa", text)
    want = [("a one", "ACGTNN"), ("empty", ""), ("b", "MKT")] + [(f"r{i}", "ACGT" * (i % 7) + "TT") for i in range(300)]
    for split in (61, 400, 1 << 20):
        got = fasta.read_sequences(spark, p, split=split).orderBy("seq_id").collect()
        assert [(r["seq_id"], r["name"], r["seq"]) for r in got] == [(i, *w) for i, w in enumerate(want)], split
    z = write(tmp_path, "y.fa.gz", gzip.compress(text.encode()[:40]) + gzip.compress(text.encode()[40:]))
    assert [(r["name"], r["seq"]) for r in fasta.read_sequences(spark, f"{p},{z}").orderBy("seq_id").collect()] == want * 2


def test_fastq_reader(spark, tmp_path):
    p = write(tmp_path, "x.fastq.gz", gzip.compress(FASTQ.encode()))
    assert [(r["name"], r["seq"]) for r in fasta.read_sequences(spark, p).orderBy("seq_id").collect()] == [("r1", "ACGTN"), ("r2", "MTEYK"), ("r3", "GATTA")]
    for bad in ("@a\nAC\n+\nI\n", "AC\n", "@a\nAC\n", "@a\nAC\n+\nIII\n"):
        with pytest.raises(SeqError):
            list(fasta.parse_fastq(bad.encode().splitlines(True)))


def test_formats_and_errors(tmp_path):
    assert fasta.detect_format("x.faa.gz") == "fasta" and fasta.detect_format("x.fq") == "fastq"
    assert fasta.detect_format(write(tmp_path, "odd", ">a\nA\n")) == "fasta"
    assert fasta.detect_format(write(tmp_path, "oddq", gzip.compress(b"@a\n"))) == "fastq"
    for name, text, code in (("no", "xx", "KC1003"), ("empty", "", "KC1002")):
        with pytest.raises(SeqError, match=code):
            fasta.detect_format(write(tmp_path, name, text))
    with pytest.raises(SeqError, match="KC1003"):
        list(fasta.parse_fasta([b"ACGT\n"]))


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_command_line(spark, tmp_path, capfd):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    small, clus, q = (write(tmp_path, n, t) for n, t in (("s.fasta", SMALL), ("c.fasta", CLUSTERS), ("q.fasta", QUERIES)))
    db, db2, idx = (f"{tmp_path}/{x}" for x in ("db", "db2", "idx"))
    assert run("createdb", small, db) == 0 and run("createdb", clus, db2, "--gpu") == 0
    assert "WARN KW2001 GPU_FLAG_REQUESTED" in capfd.readouterr().err
    assert fasta.load_meta(spark, db) == {"version": 1, "dbtype": "protein", "n_seqs": 5, "total_bases": 40, "max_seq_len": 10, "encoding": "ascii_upper", "endian": "little"}
    assert run("createdb", small, f"{tmp_path}/x", "--dbtype", "nucleotide") == 5
    assert run("createdb", small, f"{tmp_path}/x", "--max-seq-len", 9) == 5
    assert run("createdb", small, f"{tmp_path}/x", "--gpu", "--strict") == 6
    assert run("createdb", f"{tmp_path}/nope") == 2
    assert run("easy-cluster", clus, f"{tmp_path}/r", f"{tmp_path}/t", "--profile", "--print-plan") == 0
    assert "CLUSTER_DONE clusters=2 sequences=5" in capfd.readouterr().err
    assert lines(spark, f"{tmp_path}/r/clusters.tsv") == ["0\t0\t0", "0\t0\t1", "0\t0\t2", "1\t3\t3", "1\t3\t4"]
    assert lines(spark, f"{tmp_path}/r/rep_seqs.fasta")[:2] == [">seq1", LONG]
    assert run("easy-cluster", clus, f"{tmp_path}/r", f"{tmp_path}/t", "--cov-mode", 7) == 5
    opts = ("--k", 5, "--m", 8)
    assert run("build-index", db, idx, *opts) == 0
    assert run("search-index", idx, q, f"{tmp_path}/hits", *opts) == 0
    first = [x.split("\t") for x in lines(spark, f"{tmp_path}/hits")]
    assert [x[:2] for x in first] == [["q1", "0"], ["q2", "1"]] and first[0][2:6] == ["81", "1.000000", "1.000000", "4"] and first[1][2] == "99"
    assert run("update-index", idx, db2, *opts) == 0
    one = write(tmp_path, "one.fasta", f">q_segment1\n{LONG}\n")
    assert run("search-index", idx, one, f"{tmp_path}/hits2", *opts, "--top-k", 1) == 0
    hit = lines(spark, f"{tmp_path}/hits2")[0].split("\t")
    assert hit[1] == "5" and hit[6] == "1" and hit[8:] == ["seq1", "0"]
    assert run("search-index", idx, one, f"{tmp_path}/h", "--k", 6) == 5
    assert run("search-index", idx, one, f"{tmp_path}/h", *opts, "--seed", 1) == 5
    assert run("tune-index", idx) == 0 and run("index-info", idx) == 0
    out = capfd.readouterr().out
    assert "index.segments=2" in out and "segment.id=1" in out
    assert run("build-index", db, idx, "--hot-mode", "roaring") == 6


# ------------------------------------------------------------------ index and search

def plain_search(seqs, q, o, io, base=0):
    """One segment, one query, read key by key."""
    post = {}
    for i, (_, s) in enumerate(seqs):
        raw = np.frombuffer(s.encode(), np.uint8)
        for x in set((K.seeds(raw, np.array([0, len(raw)]), io.k, io.m, False)[0] ^ np.uint64(io.seed)).tolist()):
            post.setdefault(x, []).append(i)
    raw = np.frombuffer(q.encode(), np.uint8)
    h, p, _ = K.seeds(raw, np.array([0, len(raw)]), o.k, o.m, False)
    sd = [(len(post.get(x ^ io.seed, ())) or 4294967295, x, y) for x, y in zip(h.tolist(), p.tolist())]
    if not sd:
        return []
    vals = sorted(d for d, _, _ in sd)
    cut = vals[min(int(np.floor(np.float32(len(vals) - 1) * np.float32(o.prune_quantile) + np.float32(0.5))), len(vals) - 1)]
    sel = sorted(x for x in sd if x[0] <= cut)[: max(1, o.max_seeds)]
    hot = io.hot_df if io.hot_df is not None else max(len(seqs) // 64, 32)
    work, found, read = 0, 0, []
    for _, x, _ in sel:
        ids = post.get(x ^ io.seed)
        if ids is None:
            continue
        found += 1
        if o.max_df is not None and len(ids) > o.max_df:
            continue
        work += len(ids)
        w = max(1, int(np.floor(np.float32(np.log(np.float32(len(seqs) + 1) / np.float32(len(ids) + 1))) * np.float32(1024) + np.float32(0.5))))
        if not (io.hot_mode == "skip" and len(ids) >= hot):
            read += [(i, x ^ io.seed, w) for i in ids]
        if o.work_budget is not None and work >= o.work_budget and len(read) >= o.work_budget:
            break
    if o.work_budget is not None and work > 4 * o.work_budget and found <= max(1, len(sel) // 10):
        return []
    out = []
    for i in sorted({r[0] for r in read}):
        own = [r for r in read if r[0] == i]
        if len(own) < o.min_seed_hits:
            continue
        a, b, f = q.encode(), seqs[i][1].encode(), np.float32
        n = min(len(a), len(b))
        mm = K.mismatches(a, b)
        if n == 0 or mm > int(np.floor((f(1) - f(o.min_identity)) * f(n))) + 16 or f(n) / f(max(len(a), len(b))) < f(o.min_coverage) * f(0.8):
            continue
        loose = f(o.min_identity) * f(0.9)
        if mm > int(np.floor((f(1) - loose) * f(n))) or f(n - mm) / f(n) < loose:
            continue
        score, length, same = K.align_full(a, b, o.scoring)
        if not length or f(same) / f(length) < f(o.min_identity) or f(length) / f(n) < f(o.min_coverage):
            continue
        w = sum(r[2] for r in own)
        keys = sorted({r[1] for r in own})[:4]
        out.append((score + 4 * len(own) + w // 256, base + i, len(own), f"k={o.k};keys=[{', '.join(format(x, 'x') for x in keys)}];count={len(own)};w={w}"))
    return sorted(out, key=lambda x: (-x[0], x[1]))[: o.top_k]


@pytest.mark.parametrize("change", [{}, {"max_df": 3}, {"work_budget": 5}, {"max_seeds": 4, "prune_quantile": 0.5}, {"min_seed_hits": 3, "top_k": 2}, {"hot_mode": "skip", "hot_df": 4, "work_budget": 6}])
def test_search_equals_the_loop(spark, change):
    seqs = random_sequences(33, 80)
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    io = IndexOptions(k=4, m=12, **{k: v for k, v in change.items() if k.startswith("hot")})
    o = SearchOptions(k=4, m=12, min_identity=0.8, **{k: v for k, v in change.items() if not k.startswith("hot")})
    index = Index(spark, scratch_dir(spark, "idx")).build(df, io)
    queries = df.select(F.col("seq_id").alias("q"), F.col("name").alias("query_id"), "seq")
    got = {}
    for r in search.search(index, queries, o).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["score"], r["target_id"], r["seed_hits"], r["explain"]))
    want = {i: h for i, (_, s) in enumerate(seqs) if (h := plain_search(seqs, s, o, io))}
    assert got == want
    stats = search.search_stats(queries, search.search(index, queries, o)).first()
    assert (stats["queries"], stats["queries_with_hits"], stats["zero_hit_queries"]) == (len(seqs), len(want), len(seqs) - len(want))


def test_segments_and_global_ids(spark):
    a, b = frame(spark, SMALL), frame(spark, CLUSTERS)
    io = IndexOptions(k=5, m=8)
    index = Index(spark, scratch_dir(spark, "idx")).build(a, io).update(b, io)
    assert [(r["segment_id"], r["n_seqs"], r["global_seq_base"]) for r in index.rows()] == [(0, 5, 0), (1, 5, 5)]
    got = index.resolve(spark.createDataFrame([(0,), (5,), (9,), (10,)], "global_id long")).orderBy("global_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (5, 1, 0), (9, 1, 4)]
    assert [r["n_keys"] for r in index.stats().orderBy("segment_id").collect()][0] == 16
    before = [tuple(r) for r in index.stats().orderBy("segment_id").collect()]
    index.tune()
    assert [tuple(r) for r in index.tune().orderBy("segment_id").collect()] == before
    assert index.policy() == SeedPolicy()


def test_empty_index_finds_nothing(spark):
    df = frame(spark, SMALL)
    index = Index(spark, scratch_dir(spark, "idx")).build(df, IndexOptions())
    q = df.select(F.col("seq_id").alias("q"), F.col("name").alias("query_id"), "seq")
    assert search.search(index, q, SearchOptions()).collect() == []
    assert index.stats().first()["n_keys"] == 0
    variable = SearchOptions(policy=SeedPolicy("variable_k"))
    assert search.search(index, q, variable).collect() == []


def test_codec_choice_does_not_change_hits(spark):
    df = frame(spark, CLUSTERS)
    q = df.select(F.col("seq_id").alias("q"), F.col("name").alias("query_id"), "seq")
    hits = [rows(search.search(Index(spark, scratch_dir(spark, "idx")).build(df, IndexOptions(k=5, m=8, codec=c)), q, SearchOptions(k=5, m=8)).select("q", "target_id", "score", "explain")) for c in K.CODECS]
    assert hits[0] == hits[1] == hits[2] and hits[0]


def test_streams(spark, tmp_path):
    from seqloom.streaming.ingest import append_segments, search_stream

    src, ckpt = f"{tmp_path}/in", f"file://{tmp_path}/ckpt"
    frame(spark, SMALL).select("name", "seq").coalesce(1).write.parquet(src)
    index = Index(spark, scratch_dir(spark, "idx"))
    io = IndexOptions(k=5, m=8)
    read = lambda: spark.readStream.schema("name string, seq string").parquet(src)
    append_segments(read(), index, io, ckpt).awaitTermination()
    frame(spark, CLUSTERS).select("name", "seq").coalesce(1).write.mode("append").parquet(src)
    append_segments(read(), index, io, ckpt).awaitTermination()
    assert [r["n_seqs"] for r in index.rows()] == [5, 5]
    queries = read().select(F.col("name").alias("query_id"), "seq")
    search_stream(queries, index, SearchOptions(k=5, m=8), f"{tmp_path}/out", f"{ckpt}-q").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_fixture_parse():
    assert parse(SMALL)[3] == ["seq4", "PEPTIDE"]


def test_sql_functions(spark):
    from seqloom.functions import udfs

    udfs.register(spark)
    r = spark.sql("select fnv1a64('GATTACA') f, hamming_overlap('ACGT', 'ACCTT') h, sw_align('WWWW', 'WWWW') a, sw_align_banded('WWWW', 'WWAW') b, size(kmer_seeds('ACGTACGT', 5, 8, false)) n").first()
    assert r["f"] == C.signed64(10139454686114222884) and r["h"] == 1 and r["n"] == 4
    assert tuple(r["a"]) == (44, 4, 4) and tuple(r["b"]) == (K.align_pair(b"WWWW", b"WWAW", K.PROTEIN, 0.9))


def test_scratch_has_to_be_shared_off_local_mode():
    from types import SimpleNamespace

    from seqloom import storage

    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(SeqError, match="spark.checkpoint.dir"):
            storage.scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")
    conf = SimpleNamespace(get=lambda *_: "hdfs://nn/tmp/")
    assert storage.scratch_dir(SimpleNamespace(conf=conf), "x").startswith("hdfs://nn/tmp/x-")


def test_stores_by_hadoops_names(monkeypatch):
    from seqloom import storage

    seen = []
    monkeypatch.setattr(storage, "pafs", type("fs", (), {"FileSystem": type("f", (), {"from_uri": staticmethod(lambda u: seen.append(u) or (None, u))}), "LocalFileSystem": object}))
    for path in ("s3a://bucket/a b", "gs://x/y", "hdfs://n/p", "abfss://c@a.example/p"):
        storage.file_system(path)
    assert seen == ["s3://bucket/a b", "gs://x/y", "hdfs://n/p", "abfss://c@a.example/p"]
    assert storage.file_system("file:///a/b")[1] == storage.file_system("file:/a/b")[1] == "/a/b"


def test_long_chains_of_claims(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(22)], "rep long, member long")
    assert sorted(r["id"] for r in cluster.independent_set(chain).collect()) == list(range(0, 23, 2))


def test_only_what_the_screen_leaves_is_aligned(spark):
    """Catalyst evaluated both Arrow functions of a row at once, and so aligned every candidate."""
    names = "q long, segment_id int, local_id long, seed_hits long, weight long, keys array<long>"
    far = "W" * 600_000  # too long to be aligned, and unlike the query everywhere
    cands = spark.createDataFrame([(0, 0, 0, 1, 1, [1]), (0, 0, 1, 1, 1, [1])], names)
    queries = spark.createDataFrame([(0, "q", "A" * 600_000)], "q long, query_id string, seq string")
    targets = spark.createDataFrame([(0, i, "t", far, len(far), i) for i in (0, 1)], "segment_id int, local_id long, name string, seq string, seq_len long, global_id long")
    assert search.scored(cands, queries, targets, SearchOptions()).collect() == []
    pairs = spark.createDataFrame([(0, 1, 4, 4)], "rep long, member long, rep_len int, member_len int")
    seqs = spark.createDataFrame([(0, "AAAA"), (1, "WWWW")], "seq_id long, seq string")
    rows = cascade.evaluated(pairs, seqs, ClusterOptions(level="ultra"), decisions_only=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "sw_align" not in plan  # as a function beside hamming_overlap it ran before the filter
    assert plan.index("MapInArrow") < plan.index("Filter", plan.index("MapInArrow")) < plan.rindex("ArrowEvalPython")
    assert rows.collect() == []
