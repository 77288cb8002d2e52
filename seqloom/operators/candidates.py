"""Seeds, their groups and the candidate pairs they make."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterOptions
from ..functions.udfs import partner_rows, seed_rows

#: Fixed values of level fast: groups up to the first size link all members, up to the second only
#: with the longest one; larger groups say nothing.  At the other levels every group links all members.
CLIQUE, LARGEST = 64, 1024

#: Letters of a block of a group's members.
BLOCK = 4_000_000


def kmer_seeds(seqs: DataFrame, k: int, m: int, reduce: bool) -> DataFrame:
    """``seqs`` (seq_id, seq) to seeds (seq_id, hash, pos, seq_len, again)."""
    return seed_rows(seqs, k, m, reduce)


def group_members(seeds: DataFrame) -> DataFrame:
    """(hash, seq_id, seq_len) of each sequence once in each group."""
    return seeds.filter("not again").select("hash", "seq_id", "seq_len")


def group_stats(members: DataFrame) -> DataFrame:
    """(hash, n, leader, leader_len) of groups of 2 to LARGEST members; sums are partial."""
    first = F.max(F.struct(F.col("seq_len"), (-F.col("seq_id")).alias("neg")))
    return members.groupBy("hash").agg(F.count("*").alias("n"), first.alias("top")).filter(F.col("n").between(2, LARGEST)).select("hash", "n", (-F.col("top.neg")).alias("leader"), F.col("top.seq_len").alias("leader_len"))


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Unordered pairs once each, the one that is processed first as ``rep``.

    (rep, member, rep_len, member_len): longer sequences come first, then smaller ids.
    Cliques are a join of small groups with themselves (at most 64 x 64); stars add one pair a
    member, so the number of pairs is linear in the seeds.
    """
    stats = group_stats(members)
    held = members.join(stats, "hash")
    small = held.filter(F.col("n") <= CLIQUE).select("hash", F.col("seq_id").alias("a"), F.col("seq_len").alias("la"))
    other = small.select("hash", F.col("a").alias("b"), F.col("la").alias("lb"))
    first = (F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    clique = small.join(other, "hash").filter(first).select(F.col("a").alias("rep"), F.col("b").alias("member"), F.col("la").alias("rep_len"), F.col("lb").alias("member_len"))
    star = held.filter((F.col("n") > CLIQUE) & (F.col("seq_id") != F.col("leader"))).select(F.col("leader").alias("rep"), F.col("seq_id").alias("member"), F.col("leader_len").alias("rep_len"), F.col("seq_len").alias("member_len"))
    return clique.unionByName(star).distinct()


def every_pair(members: DataFrame) -> DataFrame:
    """``candidate_pairs`` of groups of any size, all members of each being linked."""
    one = members.select("hash", F.col("seq_id").alias("rep"), F.col("seq_len").alias("rep_len"))
    other = members.select("hash", F.col("seq_id").alias("member"), F.col("seq_len").alias("member_len"))
    first = (F.col("rep_len") > F.col("member_len")) | ((F.col("rep_len") == F.col("member_len")) & (F.col("rep") < F.col("member")))
    return one.join(other, "hash").filter(first).select("rep", "member", "rep_len", "member_len").distinct()


def partners(members: DataFrame, sketches: DataFrame, state: DataFrame, opts: ClusterOptions, few: int) -> DataFrame:
    """Pairs of ``every_pair`` that may pass the screen, of the sequences in ``state`` (seq_id, fixed).

    (rep, member, rep_len, member_len, more) as ``partner_rows`` gives them; ``members`` has the ``text`` of each sequence,
    ``sketches`` (text, sketch).  A large group is dealt over blocks by hash, and each two blocks are compared in a cell.
    """
    held = members.join(state, "seq_id")
    size = held.groupBy("hash").agg(F.count("*").alias("n"), F.sum("seq_len").alias("letters"), F.count_if(~F.col("fixed")).alias("free"))
    blocks = size.filter("n > 1 and free > 0").select("hash", F.ceil(F.col("letters") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = held.join(blocks, "hash").withColumn("block", F.pmod(F.xxhash64("seq_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(sketches, "text")
    th = opts.thresholds
    return partner_rows(cells.repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j"), th.prefilter_identity, th.final_coverage, opts.cov_mode, few)
