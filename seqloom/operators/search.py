"""Search of all queries at once: seeds, pruning, posting lists, candidates, alignment, top-k."""
from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..errors import WARNING, SeqError
from ..functions import columns as C
from ..functions.udfs import hamming_overlap, variable_seed_rows, with_alignment
from ..storage import stored
from .index import Index, matched

#: Document frequency of a key that no segment has.
MISSING = 4294967295


def check_options(rows, opts: SearchOptions) -> None:
    """k and seed have to be those of every segment, else nothing would be found."""
    for r in rows:
        if r["k"] != opts.k:
            raise SeqError("validation", f"search --k {opts.k} does not match index k {r['k']} (segment {r['segment_id']}); rebuild the index or pass --k {r['k']}")
        if r["seed"] != C.signed64(opts.seed):
            raise SeqError("validation", f"search --seed {opts.seed} does not match index seed {r['seed']} (segment {r['segment_id']}); pass --seed {r['seed']}")
        if r["m"] != opts.m:
            print(f"WARN {WARNING} SEARCH_M_MISMATCH query_m={opts.m} index_m={r['m']} segment={r['segment_id']}", file=sys.stderr)


def query_seeds(queries: DataFrame, opts: SearchOptions) -> DataFrame:
    """``queries`` (q, seq) to seeds (q, hash, pos, key); equal k-mers at other places all count."""
    k = C.choose_k(opts.policy, opts.k, F.length("seq"))
    rows = variable_seed_rows(queries.select(F.col("q").alias("seq_id"), "seq", k.alias("k")), opts.m)
    return rows.select(F.col("seq_id").alias("q"), "hash", "pos", F.col("hash").bitwiseXOR(F.lit(C.signed64(opts.seed))).alias("key"))


def seed_frequencies(seeds: DataFrame, postings: DataFrame) -> DataFrame:
    """Seeds with the least document frequency over all segments (MISSING if none has the key)."""
    least = matched(postings.select("key", "df"), seeds).groupBy("key").agg(F.min("df").alias("df"))
    return seeds.join(least, "key", "left").withColumn("df", F.coalesce("df", F.lit(MISSING)).cast("long"))


def pruned_seeds(seed_df: DataFrame, opts: SearchOptions) -> DataFrame:
    """Seeds kept by the frequency quantile and the cap, with their rank: by query at most m rows."""
    by_df = Window.partitionBy("q").orderBy("df")
    n = F.count("*").over(Window.partitionBy("q"))
    q = min(max(opts.prune_quantile, 0.0), 1.0)
    at = F.when(F.row_number().over(by_df) - 1 == C.rank_at(n, q), F.col("df"))
    kept = seed_df.withColumn("cut", at).withColumn("cut", F.max("cut").over(Window.partitionBy("q"))).filter(F.col("df") <= F.col("cut"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("df", C.unsigned(F.col("hash")), "pos"))
    return kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= max(1, opts.max_seeds)).drop("cut")


def selected_seeds(queries: DataFrame, index: Index, opts: SearchOptions) -> DataFrame:
    """The pruned seeds of ``queries``, stored."""
    seeds = stored(query_seeds(queries, opts), "query-seeds")
    return stored(pruned_seeds(seed_frequencies(seeds, index.postings()), opts), "selected-seeds")


def probed(selected: DataFrame, postings: DataFrame, segments: DataFrame, opts: SearchOptions) -> DataFrame:
    """(q, segment_id, key, rank, df, tier, n_seqs, visible, ...) of found keys within the budget.

    Keys over max_df count as found and are not read; lists of hot keys are invisible where hot
    keys are skipped, though their frequency counts as work.  With a budget, seeds are read until
    both the frequencies and the postings reach it, and a segment goes if it was far too much
    work for the few seeds that it answered.
    """
    left = selected.withColumnRenamed("df", "least_df")
    own = F.broadcast(segments.select("segment_id", "n_seqs", "hot_mode"))  # a row a segment
    rows = left.join(postings.hint("merge"), "key").join(own, "segment_id").withColumn("visible", ~((F.col("tier") == "hot") & (F.col("hot_mode") == "skip")))
    live = F.lit(True) if opts.max_df is None else F.col("df") <= opts.max_df
    rows = rows.withColumn("live", live)
    if opts.work_budget is None:
        return rows.filter("live")
    w = Window.partitionBy("q", "segment_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("live"), F.col("df")).otherwise(0)
    pairs = F.when(F.col("live") & F.col("visible"), F.col("df")).otherwise(0)
    b = opts.work_budget
    rows = rows.withColumn("work", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("read", F.coalesce(F.sum(pairs).over(w), F.lit(0)))
    started = F.coalesce(F.max(F.col("live").cast("int")).over(w), F.lit(0)) == 1
    rows = rows.withColumn("started", started).filter(~(F.col("started") & (F.col("work") >= b) & (F.col("read") >= b)))
    whole = Window.partitionBy("q", "segment_id")
    n = selected.groupBy("q").agg(F.count("*").alias("n_selected"))
    rows = rows.withColumn("total", F.sum(size).over(whole)).withColumn("found", F.count("*").over(whole)).join(n, "q")
    few = F.col("found") <= F.greatest(F.lit(1), F.floor(F.col("n_selected") / 10))
    return rows.filter(~((F.col("total") > 4 * b) & few) & F.col("live"))


def candidates(found: DataFrame, opts: SearchOptions) -> DataFrame:
    """(q, segment_id, local_id, seed_hits, weight, keys): sums over the postings of found keys."""
    w = C.seed_weight(F.col("n_seqs"), F.col("df"))
    rows = found.filter("visible").withColumn("w", w).select("q", "segment_id", F.explode("seq_ids").alias("local_id"), C.unsigned(F.col("key")).alias("ukey"), "w")
    out = rows.groupBy("q", "segment_id", "local_id").agg(F.count("*").alias("seed_hits"), F.sum("w").alias("weight"), F.slice(F.sort_array(F.collect_set("ukey")), 1, 4).alias("keys"))
    return out.filter(F.col("seed_hits") >= opts.min_seed_hits)


HIT_COLUMNS = ("query_id", "target_id", "score", "identity", "coverage", "seed_hits", "segment_id", "explain", "target_name", "local_id")


def scored(cands: DataFrame, queries: DataFrame, targets: DataFrame, opts: SearchOptions) -> DataFrame:
    """Candidates that pass the filters and the alignment, with their score and explanation."""
    target = targets.select("segment_id", "local_id", F.col("name").alias("target_name"), F.col("seq").alias("target"), F.col("seq_len").cast("int").alias("tlen"), "global_id")
    query = queries.select("q", "query_id", F.col("seq").alias("query"), F.length("seq").alias("qlen"))
    overlap = F.least("qlen", "tlen")
    ident, cover = np.float32(opts.min_identity), np.float32(opts.min_coverage)
    loose_id, loose_cov = float(np.clip(ident * np.float32(0.9), 0, 1)), float(np.clip(cover * np.float32(0.8), 0, 1))
    # lengths alone can rule a pair out; only the rest fetches the query's residues
    rows = cands.join(target, ["segment_id", "local_id"]).join(query, "q")
    rows = rows.filter((overlap > 0) & (C.div32(overlap, F.greatest("qlen", "tlen")) >= C.f32(loose_cov)))
    rows = rows.withColumn("mm", hamming_overlap("query", "target"))
    near = (F.col("mm") <= C.allowed_mismatches(float(ident), overlap) + 16) & C.ungapped_ok(F.col("mm"), overlap, F.greatest("qlen", "tlen"), loose_id, loose_cov)
    rows = with_alignment(rows.filter(near), "query", "target", opts.scoring)
    identity = C.div32(F.col("matches"), F.col("aligned_len"))
    coverage = C.div32(F.col("aligned_len"), overlap)
    rows = rows.withColumn("identity", identity).withColumn("coverage", coverage).filter((F.col("aligned_len") > 0) & (F.col("identity") >= C.f32(ident)) & (F.col("coverage") >= C.f32(cover)))
    k = C.choose_k(opts.policy, opts.k, F.col("qlen"))
    keys = F.array_join(F.transform("keys", lambda x: C.hex64(C.unsigned(x))), ", ")
    explain = F.format_string("k=%d;keys=[%s];count=%d;w=%d", k, keys, F.col("seed_hits"), F.col("weight"))
    score = (F.col("score") + 4 * F.col("seed_hits") + F.expr("weight div 256")).cast("int")
    return rows.select("q", "query_id", F.col("global_id").alias("target_id"), score.alias("score"), "identity", "coverage", F.col("seed_hits").cast("int").alias("seed_hits"), "segment_id", explain.alias("explain"), "target_name", "local_id")


def top_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """The best hits of each query, ranked; hits of a query are at most its candidates."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "target_id", "segment_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def search(index: Index, queries: DataFrame, opts: SearchOptions) -> DataFrame:
    """``queries`` (q, query_id, seq), q unique and in input order, to ranked hits."""
    rows = index.rows()
    check_options(rows, opts)
    selected = selected_seeds(queries, index, opts)
    found = probed(selected, index.lists(selected), index.segments(), opts)
    cands = candidates(found, opts)
    return top_hits(scored(cands, queries, index.with_global_ids(), opts), opts.top_k)


def search_stats(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: queries, queries_with_hits, total_hits, zero_hit_queries."""
    per = hits.groupBy("q").agg(F.count("*").alias("n"))
    return queries.select("q").join(per, "q", "left").agg(
        F.count("*").alias("queries"), F.count("n").alias("queries_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_hits"), (F.count("*") - F.count("n")).alias("zero_hit_queries")
    )
