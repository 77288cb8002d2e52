"""The filter cascade over candidate pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterOptions
from ..functions import columns as C
from ..functions.udfs import hamming_overlap, with_banded_alignment


def with_sequences(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs with both sequences (rep_seq, member_seq)."""
    return pairs.join(seqs.select(F.col("seq_id").alias("rep"), F.col("seq").alias("rep_seq")), "rep").join(seqs.select(F.col("seq_id").alias("member"), F.col("seq").alias("member_seq")), "member")


def screened(pairs: DataFrame, seqs: DataFrame, opts: ClusterOptions, decisions_only: bool = False) -> DataFrame:
    """Pairs with ``mismatches`` and ``reject``: 'hamming', 'ungapped' or null if they pass the screen.

    Coverage depends on the lengths alone; if only decisions are wanted, pairs that can't reach
    it are dropped before any sequence is fetched.
    """
    th = opts.thresholds
    cov = C.coverage_possible(F.col("member_len"), F.col("rep_len"), th.final_coverage, opts.cov_mode)
    if decisions_only:
        pairs = pairs.filter(cov)
    overlap = F.least("rep_len", "member_len")
    full = with_sequences(pairs, seqs).withColumn("mismatches", hamming_overlap("rep_seq", "member_seq"))
    reject = (
        F.when(F.col("mismatches") > C.allowed_mismatches(th.prefilter_identity, overlap), "hamming")
        .when(~cov, "ungapped")
        .when(~C.ungapped_ok(F.col("mismatches"), overlap, F.greatest("rep_len", "member_len"), th.prefilter_identity, 0.0), "ungapped")
    )
    return full.withColumn("reject", reject)


def evaluated(pairs: DataFrame, seqs: DataFrame, opts: ClusterOptions, decisions_only: bool = False) -> DataFrame:
    """(rep, member, rep_len, member_len, mismatches, score, aligned_len, matches, reject).

    ``reject`` null: the pair passes.  At level fast the screen decides; the other levels align
    what it leaves.
    """
    th = opts.thresholds
    keep = ["rep", "member", "rep_len", "member_len", "mismatches"]
    rows = screened(pairs, seqs, opts, decisions_only)
    if decisions_only:
        rows = rows.filter("reject is null")
    none = [F.lit(None).cast("int").alias(c) for c in ("score", "aligned_len", "matches")]
    if not th.gapped:
        return rows.select(*keep, *none, "reject")
    out = rows.filter("reject is not null").select(*keep, *none, "reject")
    left = rows.filter("reject is null")
    aligned = with_banded_alignment(left.select(*keep, "rep_seq", "member_seq"), "rep_seq", "member_seq", opts.scoring, opts.min_identity)
    same = C.div32(F.col("matches"), F.col("aligned_len")) >= C.f32(th.final_identity)
    good = (F.col("aligned_len") > 0) & same & C.coverage_ok(F.col("aligned_len"), F.col("member_len"), F.col("rep_len"), th.final_coverage, opts.cov_mode)
    done = aligned.select(*keep, "score", "aligned_len", "matches", F.when(~F.coalesce(good, F.lit(False)), "gapped").alias("reject"))
    return done if decisions_only else out.unionByName(done)
