"""Command line: ``python -m seqloom.cli COMMAND ...``."""
from __future__ import annotations

import argparse
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from .config import ClusterOptions, IndexOptions, SearchOptions, SeedPolicy, scoring_for
from .errors import WARNING, SeqError

POLICIES = {"fixed-k": "fixed_k", "variable-k": "variable_k", "syncmer": "syncmer"}


def _log(opts, level: str, event: str, message: str) -> None:
    if not getattr(opts, "quiet", False):
        print(f"{level} {event} {message}", file=sys.stderr)


def _common(p: argparse.ArgumentParser) -> None:
    a = p.add_argument
    a("--threads", type=int, default=1)
    a("--tmp-dir", dest="tmp_dir_opt")
    a("--min-seq-id", type=float)
    a("-c", "--cov-mode", type=int)
    a("--cov", type=float)
    a("--kmer-per-seq", "--k-mer-per-seq", type=int)
    a("--kmer-size", "--k-mer-size", type=int)
    a("--max-seq-len", type=int)
    a("--dbtype", choices=["auto", "protein", "nucleotide"], default="auto")
    a("--seed", type=int, default=42)
    for flag in ("strict", "quiet", "verbose", "print-plan", "profile", "gpu", "cuda"):
        a(f"--{flag}", action="store_true")
    a("--profile-json")
    a("--compare-mmseqs-mode", choices=["linclust", "cluster"])
    a("--gpu-backend", choices=["cuda"])
    a("--alignment-mode", choices=["fast", "sensitive"])
    a("--cascade-level", choices=["fast", "medium", "sensitive", "ultra"])
    a("--sensitivity", type=float)
    for name in ("batch-size", "gpu-memory-limit", "cpu-threads", "gap-open", "gap-extend"):
        a(f"--{name}", type=int)
    a("--sub-matrix")


def _index_options(p: argparse.ArgumentParser) -> None:
    a = p.add_argument
    a("--k", type=int, default=14)
    a("--m", type=int, default=20)
    a("--seed", type=int, default=42)
    a("--hot-df-threshold", type=int)
    a("--hot-mode", choices=["skip", "roaring", "bp128"], default="bp128")
    a("--legacy-uncompressed", action="store_true")
    a("--pgm-epsilon", type=int, default=64)
    a("--seed-policy", choices=list(POLICIES))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description="Clustering and search of sequences on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, *places):
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        return p

    _common(add("createdb", "input", "dbdir"))
    _common(add("easy-cluster", "input", "result_dir", "tmp_dir"))
    _index_options(add("build-index", "dbdir", "indexdir"))
    _index_options(add("update-index", "indexdir", "new_dbdir"))
    p = add("search-index", "indexdir", "query_fasta", "out_tsv")
    for name, kind, default in (("k", int, 14), ("m", int, 20), ("top-k", int, 10), ("min-seed-hits", int, 1), ("min-seq-id", float, 0.9), ("cov", float, 0.8), ("max-df", int, None), ("prune-df-quantile", float, 0.9), ("max-seeds-per-query", int, 128), ("work-budget", int, None), ("k-mer-size-set", str, None), ("seed", int, 42)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--seed-policy", choices=list(POLICIES))
    p = add("tune-index", "indexdir")
    p.add_argument("--pgm-epsilon", type=int, default=64)
    p.add_argument("--seed-policy", choices=list(POLICIES))
    add("index-info", "indexdir")
    p = add("serve", "indexdir")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    return top


def check_common(o) -> None:
    """Ranges of the common options, then the warnings; any warning is an error with --strict."""
    rules = [
        (o.threads >= 1, "--threads must be >= 1"), (o.min_seq_id is None or 0 <= o.min_seq_id <= 1, "--min-seq-id must be within 0..1"),
        (o.cov_mode is None or o.cov_mode in (0, 1, 2, 3), "--cov-mode must be one of 0,1,2,3"), (o.cov is None or 0 <= o.cov <= 1, "--cov must be within 0..1"),
        (o.kmer_size is None or o.kmer_size >= 1, "--kmer-size must be >= 1"), (o.kmer_per_seq is None or o.kmer_per_seq >= 1, "--kmer-per-seq must be >= 1"),
        (o.sensitivity is None or o.sensitivity >= 0, "--sensitivity must be >= 0"), (o.batch_size is None or o.batch_size >= 1, "--batch-size must be >= 1"),
        (o.cpu_threads is None or o.cpu_threads >= 1, "--cpu-threads must be >= 1"),
    ]
    for good, message in rules:
        if not good:
            raise SeqError("validation", message)
    warnings = sorted((["GPU_FLAG_REQUESTED"] if o.gpu or o.cuda else []) + ([f"UNIMPLEMENTED_SUB_MATRIX {o.sub_matrix}"] if o.sub_matrix and o.sub_matrix.lower() not in ("simple", "blosum62") else []))
    for w in warnings:
        _log(o, "WARN", WARNING, w)
    if o.strict and warnings:
        raise SeqError("unsupported", "strict mode: unimplemented flags present")


def cluster_options(o, dbtype: str) -> ClusterOptions:
    level = o.cascade_level or o.alignment_mode or "fast"
    some = lambda v, default: default if v is None else v
    return ClusterOptions(
        min_identity=some(o.min_seq_id, 0.9), min_coverage=some(o.cov, 0.8), cov_mode=some(o.cov_mode, 0), kmers_per_seq=some(o.kmer_per_seq, 20), k=o.kmer_size,
        sensitivity=some(o.sensitivity, 1.0), level=level, dbtype=dbtype, sub_matrix=(o.sub_matrix or "blosum62").lower(), gap_open=o.gap_open, gap_extend=o.gap_extend,
    )


def _plan(o, **first) -> None:
    for k, v in first.items():
        print(f"plan.{k}={v}")
    for k, v in sorted(vars(o).items()):
        if k not in ("command", "input", "dbdir", "result_dir", "tmp_dir", "print_plan"):
            print(f"plan.{'requested_dbtype' if k == 'dbtype' else k}={'none' if v is None else str(v).lower() if isinstance(v, bool) else v}")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("seqloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def createdb(o, spark):
    from .sources import fasta

    _log(o, "INFO", "BACKEND", "spark")
    check_common(o)
    meta = fasta.createdb(spark, o.input, o.dbdir, o.dbtype, o.max_seq_len)
    if o.print_plan:
        _plan(o, command="createdb", resolved_dbtype=meta["dbtype"], n_seqs=meta["n_seqs"], total_bases=meta["total_bases"])


def easy_cluster(o, spark):
    from .operators import cluster as c
    from .operators.profile import Profiler
    from .sources import fasta, sinks
    from .storage import stored

    _log(o, "INFO", "BACKEND", "spark")
    check_common(o)
    prof = Profiler()
    with prof.stage("total"):
        with prof.stage("parse_ingest"):
            db = o.input
            if not fasta.is_db(spark, db):
                db = f"{o.tmp_dir}/query_db"
                fasta.createdb(spark, o.input, db, o.dbtype, o.max_seq_len)
            meta, seqs = fasta.load_meta(spark, db), fasta.load_db(spark, db)
        opts = cluster_options(o, meta["dbtype"]).check()
        if o.print_plan:
            _plan(o, command="easy-cluster", resolved_dbtype=meta["dbtype"], n_seqs=meta["n_seqs"])
        if o.compare_mmseqs_mode:
            print(f"Comparison parameters:\n  mode: {o.compare_mmseqs_mode}\n  min_seq_id: {opts.min_identity}\n  cov_mode: {opts.cov_mode}\n  coverage: {opts.min_coverage}")
        with prof.stage("greedy_assignment"):
            clusters = stored(c.cluster(seqs, opts), "clusters")
        with prof.stage("write_outputs"):
            sinks.write_clusters(clusters, f"{o.result_dir}/clusters.tsv")
            sinks.write_fasta(c.representatives(clusters, seqs), f"{o.result_dir}/rep_seqs.fasta")
    _log(o, "INFO", "CLUSTER_DONE", f"clusters={clusters.filter('rep_id = member_id').count()} sequences={meta['n_seqs']}")
    if o.profile or o.profile_json:
        report = prof.report(c.counters(seqs, opts))
        if o.profile:
            for k, v in report.items():
                print(f"profile.{k}={v}")
        if o.profile_json:
            sinks.write_report(report, o.profile_json, spark)


def _options(o) -> IndexOptions:
    return IndexOptions(o.k, o.m, o.seed, o.hot_df_threshold, o.hot_mode, "vbyte" if o.legacy_uncompressed else "bp128").check()


def build_index(o, spark):
    from .operators.index import Index
    from .sources import fasta

    meta = fasta.load_meta(spark, o.dbdir)
    policy = SeedPolicy.named(POLICIES[o.seed_policy] if o.seed_policy else "fixed_k", o.k, o.m)
    Index(spark, o.indexdir).build(fasta.load_db(spark, o.dbdir), _options(o), meta["dbtype"], o.dbdir, policy)


def update_index(o, spark):
    from .operators.index import Index
    from .sources import fasta

    meta = fasta.load_meta(spark, o.new_dbdir)
    Index(spark, o.indexdir).update(fasta.load_db(spark, o.new_dbdir), _options(o), meta["dbtype"], o.new_dbdir)


def search_index(o, spark):
    from pyspark.sql import functions as F

    from .operators import search as s
    from .operators.index import Index
    from .sources import fasta, sinks
    from .storage import stored

    index = Index(spark, o.indexdir)
    rows = index.rows()
    if o.seed_policy == "syncmer":
        print(f"WARN {WARNING} UNIMPLEMENTED_FLAG --seed-policy syncmer", file=sys.stderr)
    policy = SeedPolicy.named(POLICIES.get(o.seed_policy), o.k, o.m) or index.policy()
    opts = SearchOptions(o.k, o.m, o.seed, o.top_k, o.min_seed_hits, o.min_seq_id, o.cov, o.max_df, o.prune_df_quantile, o.max_seeds_per_query, o.work_budget, policy, scoring_for(rows[0]["dbtype"] if rows else "protein"))
    queries = stored(fasta.read_sequences(spark, o.query_fasta, "fasta").select(F.col("seq_id").alias("q"), F.col("name").alias("query_id"), "seq"), "queries")
    hits = stored(s.search(index, queries, opts), "hits")
    sinks.write_hits(hits, o.out_tsv)
    st = s.search_stats(queries, hits).first()
    print(f"INFO SEARCH_DONE queries={st['queries']} hits={st['total_hits']} zero_hit_queries={st['zero_hit_queries']}", file=sys.stderr)


def tune_index(o, spark):
    from .operators.index import Index

    if o.seed_policy == "syncmer":
        print(f"WARN {WARNING} UNIMPLEMENTED_FLAG --seed-policy syncmer", file=sys.stderr)
    Index(spark, o.indexdir).tune(POLICIES.get(o.seed_policy))


def index_info(o, spark):
    from .operators.index import Index

    rows = sorted(Index(spark, o.indexdir).info().collect(), key=lambda r: r["segment_id"])
    print(f"index.version=1\nindex.segments={len(rows)}")
    for r in rows:
        print(f"segment.id={r['segment_id']}\nsegment.keys={r['n_keys']}\nsegment.codec_hot={r['codec']}\nsegment.codec_cold={r['codec']}\nsegment.bytes={r['posting_bytes'] or 0}")
    print(f"index.bytes_total={sum(r['posting_bytes'] or 0 for r in rows)}")


def serve(o, spark):
    from .operators.index import Index

    Index(spark, o.indexdir).rows()
    print(f"WARN {WARNING} EXPERIMENTAL serve is a stub: it answers a single request with a static JSON body and exits", file=sys.stderr)

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            body = b'{"status":"ok","message":"serve stub"}'
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    with HTTPServer((o.host, o.port), Stub) as server:
        server.handle_request()


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        o = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        globals()[o.command.replace("-", "_")](o, spark or _session())
    except SeqError as e:
        print(f"ERROR {e}", file=sys.stderr)
        return e.status
    return 0


if __name__ == "__main__":
    sys.exit(main())
