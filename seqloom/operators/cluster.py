"""Greedy star clustering as a maximal independent set, in rounds.

The greedy loop takes sequences longest first; one that no earlier representative has claimed
becomes a representative and claims its passing candidates.  Whether a pair passes does not
depend on the loop, so the representatives are the lexicographically first maximal independent
set over the passing pairs, and each round can settle all sequences without an undecided
predecessor at once.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterOptions
from ..functions.kernels import MAX_DP_CELLS
from ..functions.udfs import sketch_rows
from ..storage import stored
from .candidates import candidate_pairs, every_pair, group_members, kmer_seeds, partners
from .cascade import evaluated
from .ranking import dense_index


#: Rounds whose representatives are written together, so that plans stay short however many there are.
ROUNDS = 8


#: Partners of a sequence that are listed at first; each time after it are more times as many.
FEW, GROWTH = 8, 8


def independent_set(edges: DataFrame) -> DataFrame:
    """(id) of representatives among the ends of ``edges`` (rep, member), rep being the earlier.

    There are as many rounds as the longest chain of claims has links.
    """
    return settled(edges)[0]


def settled(edges: DataFrame, waiting: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``independent_set``, and the ends of ``edges`` that stay undecided as those of ``waiting`` (id) can't be chosen yet."""
    left = stored(edges.select("rep", "member").distinct(), "edges")
    rounds: list[DataFrame] = []
    undecided = stored(left.select(F.explode(F.array("rep", "member")).alias("id")).distinct(), "undecided")
    while not undecided.isEmpty():
        fresh = undecided.join(left.select(F.col("member").alias("id")).distinct(), "id", "left_anti")
        fresh = stored(fresh if waiting is None else fresh.join(waiting, "id", "left_anti"), "chosen")
        if waiting is not None and fresh.isEmpty():
            break
        rounds.append(fresh)
        if len(rounds) > ROUNDS:
            rounds = [stored(reduce(DataFrame.unionByName, rounds), "chosen")]
        claimed = left.join(fresh.select(F.col("id").alias("rep")), "rep", "left_semi").select(F.col("member").alias("id")).distinct()
        undecided = stored(undecided.join(fresh, "id", "left_anti").join(claimed, "id", "left_anti"), "undecided")
        for end in ("rep", "member"):
            left = left.join(undecided.select(F.col("id").alias(end)), end, "left_semi")
        left = stored(left, "edges")
    return (reduce(DataFrame.unionByName, rounds) if rounds else undecided.limit(0)), undecided


def assign(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(cluster_id, rep_id, member_id) of all sequences in ``lengths`` (seq_id, seq_len).

    ``edges`` (rep, member, rep_len): the passing pairs.  A member joins the first of its
    representatives; clusters are numbered in the order in which their representatives come.
    """
    return numbered(placed(edges, lengths))


def placed(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """``lengths`` with the ``rep_id`` of each sequence."""
    edges = stored(edges.select("rep", "member", "rep_len"), "passing")
    reps = independent_set(edges)
    held = edges.join(reps.select(F.col("id").alias("rep")), "rep", "left_semi")
    first = F.min(F.struct((-F.col("rep_len")).alias("neg"), F.col("rep"))).alias("first")
    joined = held.join(reps.select(F.col("id").alias("member")), "member", "left_anti").groupBy("member").agg(first).select(F.col("member").alias("seq_id"), F.col("first.rep").alias("rep_id"))
    return stored(lengths.join(joined, "seq_id", "left").withColumn("rep_id", F.coalesce("rep_id", "seq_id")), "placed")


def numbered(placed: DataFrame) -> DataFrame:
    """(cluster_id, rep_id, member_id) of ``placed`` (seq_id, seq_len, rep_id)."""
    numbers = dense_index(placed.filter("seq_id = rep_id").select("rep_id", "seq_len"), [F.desc("seq_len"), F.asc("rep_id")], "cluster_id").select("rep_id", "cluster_id")
    return placed.join(numbers, "rep_id").select(F.col("cluster_id").cast("int").alias("cluster_id"), "rep_id", F.col("seq_id").alias("member_id"))


def lengths_of(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.length("seq").cast("int").alias("seq_len"))


def pairs_of(seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """Candidate pairs of sequences (seq_id, seq)."""
    seeds = stored(kmer_seeds(seqs, opts.kmer_size, opts.seeds_per_seq, opts.reduced), "seeds")
    return candidate_pairs(group_members(seeds))


def passing(pairs: DataFrame, seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """The passing ones of few ``pairs``: the sequences that they need are taken out once, so that no others are moved."""
    ends = pairs.select(F.explode(F.array("rep", "member")).alias("seq_id")).distinct()
    needed = stored(seqs.join(ends, "seq_id", "left_semi"), "needed")
    return evaluated(pairs, needed, opts, decisions_only=True).filter("reject is null")


def passing_pairs(members: DataFrame, sketches: DataFrame, seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """Passing pairs (rep, member, rep_len) of groups of any size that settle every sequence as all passing pairs would.

    Groups of like sequences have pairs in the square of their size, nearly all of which the greedy loop never evaluates.
    So the first partners of each sequence are evaluated, which settles the sequences whose partners are all known, and
    those that are claimed; the others go on with more partners, and with all the representatives found.  What was claimed
    before all of its partners were known gets those that are representatives at the end, so that it joins the first.
    """

    def listed(state: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
        pairs = stored(partners(members, sketches, state, opts, few), "partners")
        good = passing(pairs.select("rep", "member", "rep_len", "member_len").distinct(), seqs, opts)
        return stored(good.select("rep", "member", "rep_len"), "passing"), stored(pairs.filter("more").select(F.col("member").alias("id")).distinct(), "waiting")

    few, found, late = FEW, [], []
    state = stored(members.select("seq_id", F.lit(False).alias("fixed")).distinct(), "state")
    while True:
        edges, waiting = listed(state, few)
        found.append(edges)
        if waiting.isEmpty():
            break
        fixed, free = (state.filter(c).select(F.col("seq_id").alias("id")) for c in ("fixed", "not fixed"))
        claimed = edges.join(fixed.select(F.col("id").alias("rep")), "rep", "left_semi").select(F.col("member").alias("id")).distinct()
        free = stored(free.join(claimed, "id", "left_anti"), "undecided")
        for end in ("rep", "member"):
            edges = edges.join(free.select(F.col("id").alias(end)), end, "left_semi")
        edges = stored(edges, "edges")
        chosen, open_ = settled(edges, waiting)
        apart = free.join(edges.select(F.explode(F.array("rep", "member")).alias("id")).distinct(), "id", "left_anti")
        open_ = stored(open_.unionByName(apart.join(waiting, "id", "left_semi")), "open")
        reps = stored(fixed.unionByName(chosen).unionByName(apart.join(waiting, "id", "left_anti")), "representatives")
        late.append(stored(waiting.join(open_, "id", "left_anti").join(reps, "id", "left_anti"), "late"))
        state = stored(reps.select(F.col("id").alias("seq_id"), F.lit(True).alias("fixed")).union(open_.select("id", F.lit(False))), "state")
        few *= GROWTH
    edges = reduce(DataFrame.unionByName, found).distinct()
    if late and not (late := reduce(DataFrame.unionByName, late)).isEmpty():
        edges = stored(edges, "passing")
        ends = edges.select(F.explode(F.array("rep", "member")).alias("id")).distinct()
        claimed = ends.join(independent_set(edges), "id", "left_anti")
        reps = members.select(F.col("seq_id").alias("id")).distinct().join(claimed, "id", "left_anti")
        edges = edges.unionByName(listed(stored(reps.select(F.col("id").alias("seq_id"), F.lit(True).alias("fixed")).union(late.select("id", F.lit(False))), "state"), 1)[0]).distinct()
    return edges


def cluster_whole(seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """``cluster`` with groups of any size, all of whose members are candidates of each other.

    Copies of a text go where their first one goes, if the text passes with itself, and so do they if it can't be aligned
    with any text of its length for its size, except that they then stay alone when the first one is a representative.  Copies
    of a text that doesn't pass with itself for other reasons are sequences of their own, but never partners.
    """
    seqs = stored(seqs.select("seq_id", "seq"), "sequences")
    members = group_members(stored(kmer_seeds(seqs, opts.kmer_size, opts.seeds_per_seq, opts.reduced), "seeds"))
    keyed = stored(seqs.select("seq_id", F.sha2("seq", 256).alias("key"), F.length("seq").cast("int").alias("seq_len")), "texts")
    same = keyed.join(members.select("seq_id").distinct(), "seq_id", "left_semi").groupBy("key").agg(F.min("seq_id").alias("text"), F.max("seq_id").alias("other"), F.first("seq_len").alias("len"))
    same = stored(same, "same")
    alike = same.filter("text <> other").select(F.col("text").alias("rep"), F.col("other").alias("member"), F.col("len").alias("rep_len"), F.col("len").alias("member_len"))
    fits = F.col("rep_len").cast("long") * F.col("member_len") <= MAX_DP_CELLS
    good = passing(alike.filter(fits), seqs, opts).select(F.col("rep").alias("text"), F.lit(True).alias("joins"))
    kind = same.join(good, "text", "left").select("key", "text", F.coalesce("joins", F.lit(False)).alias("joins"), (F.col("len").cast("long") * F.col("len") > MAX_DP_CELLS).alias("large"))
    texts = stored(keyed.join(kind, "key", "left").select("seq_id", "seq_len", "text", "joins", "large"), "texts")
    copy = F.coalesce((F.col("seq_id") != F.col("text")) & (F.col("joins") | F.col("large")), F.lit(False))
    nodes = texts.filter(~copy)
    own = stored(members.join(nodes.filter("text is not null").select("seq_id", "text"), "seq_id"), "members")
    sketches = stored(sketch_rows(seqs.join(texts.filter("seq_id = text").select("seq_id"), "seq_id", "left_semi")).select(F.col("seq_id").alias("text"), "sketch"), "sketches")
    at = placed(passing_pairs(own, sketches, seqs, opts), nodes.select("seq_id", "seq_len"))
    first = at.select(F.col("seq_id").alias("text"), F.col("rep_id").alias("its"))
    alone = ~F.col("joins") & (F.col("its") == F.col("text"))
    copies = texts.filter(copy).join(first, "text").select("seq_id", "seq_len", F.when(alone, F.col("seq_id")).otherwise(F.col("its")).alias("rep_id"))
    return numbered(stored(at.unionByName(copies), "placed"))


def cluster(seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """(cluster_id, rep_id, member_id) of ``seqs`` (seq_id, seq)."""
    opts.check()
    if opts.thresholds.gapped:
        return cluster_whole(seqs, opts)
    passing = evaluated(pairs_of(seqs, opts), seqs, opts, decisions_only=True).filter("reject is null")
    return assign(passing, lengths_of(seqs))


COUNTERS = ("seeds_generated", "unique_kmers", "total_posting_length_read", "candidate_pairs_evaluated", "hamming_rejected", "ungapped_rejected", "gapped_rejected", "assigned_pairs")


def counters(seqs: DataFrame, opts: ClusterOptions) -> DataFrame:
    """One row of work counters, as the sequential loop would count them.

    A pair (r, c) is evaluated when r is a representative, c comes after r and isn't claimed by a
    representative before r.
    """
    opts.check()
    lens = lengths_of(seqs)
    seeds = stored(kmer_seeds(seqs, opts.kmer_size, opts.seeds_per_seq, opts.reduced), "seeds")
    pairs = stored((every_pair if opts.thresholds.gapped else candidate_pairs)(group_members(seeds)), "pairs")
    judged = stored(evaluated(pairs, seqs, opts), "judged")
    clusters = stored(assign(judged.filter("reject is null"), lens), "clusters")
    reps = clusters.filter("rep_id = member_id").select(F.col("rep_id").alias("rep"))
    both = pairs.select("rep", "member").union(pairs.select("member", "rep")).toDF("rep", "other")
    read = both.join(reps, "rep", "left_semi").agg(F.count("*").alias("total_posting_length_read"))
    rep_len = lens.select(F.col("seq_id").alias("rep_id"), F.col("seq_len").alias("own_len"))
    owner = clusters.join(rep_len, "rep_id").select(F.col("member_id").alias("member"), F.col("rep_id").alias("own"), "own_len")
    later = (F.col("own_len") < F.col("rep_len")) | ((F.col("own_len") == F.col("rep_len")) & (F.col("own") >= F.col("rep")))
    seen = judged.join(reps, "rep", "left_semi").join(owner, "member").filter(later)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    work = seen.agg(
        F.count("*").alias("candidate_pairs_evaluated"), *[count(F.col("reject") == x).alias(f"{x}_rejected") for x in ("hamming", "ungapped", "gapped")],
        count(F.col("reject").isNull()).alias("assigned_pairs"),
    )
    made = seeds.agg(F.count("*").alias("seeds_generated"), F.countDistinct("hash").alias("unique_kmers"))
    return made.crossJoin(read).crossJoin(work).select(*COUNTERS)  # three tables of one row


def representatives(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """(cluster_id, name, seq) of the representatives."""
    return clusters.filter("rep_id = member_id").join(seqs, F.col("rep_id") == F.col("seq_id")).select("cluster_id", "name", "seq")


def pairwise_recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Share of the pairs of ``wanted`` clusters that ``found`` has too (1 if there are none).

    Counted from the sizes of the overlaps of clusters, so no pair is ever made.
    """
    two = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    both = found.select(F.col("cluster_id").alias("f"), "member_id").join(wanted.select(F.col("cluster_id").alias("w"), "member_id"), "member_id")
    hit = both.groupBy("f", "w").agg(F.count("*").alias("n")).agg(two(F.col("n")).alias("hit"))
    all_ = wanted.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(two(F.col("n")).alias("total"))
    return hit.crossJoin(all_).select(F.col("total").cast("long").alias("wanted_pairs"), F.col("hit").cast("long").alias("found_pairs"), F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("hit") / F.col("total")).alias("recall"))
