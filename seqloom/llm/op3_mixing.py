"""Mixing of sources to target weights: temperature, bisection, budgeted block permutations.

A source with a share p of all tokens (words without white space) gets a weight in proportion
to p ** alpha: 1 leaves the mix as it is, 0 makes it even.  alpha is bisected in [0, 1] to the
target entropy (a share of the entropy of an even mix); if a source would then be repeated more
than MAX_REPEATS times, alpha is bisected upwards until none is.  The repetition at alpha = 1 is
budget / tokens for all sources, the least that any mix has, and is accepted where it is over
the limit.  Each round of the search evaluates 31 exponents in one aggregation, which settles
five bisections, so no list of sources is ever held on the driver.

The weights are realised exactly up to one document a source.  Documents of a source fall into
BLOCKS blocks by a hash of id and text.  Every epoch has its own permutation of the blocks; whole
epochs take all of them, the last epoch takes blocks in order while the source's budget lasts,
and of the block in which it ends the documents in order of a hash.  So the only running sums
are over the blocks of a source (BLOCKS rows) and over the documents of one block, whatever
share of the rows a source has.

Defined results: a null source is the source ''; texts that are null or without words have no
tokens and come with their block; a source without tokens gives no rows; an empty table gives
none; rows that repeat an id, and rows without one, are separate documents; extra columns are ignored.
The pipeline stage knows a row by its file and its line there, plans the mix with these alone and joins the whole
rows once.  It writes each file in the order of the mix; rows fall into files at random, so every file holds
the interleaved sources at their weights, and copies of a document stand apart.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
BLOCKS = 4096
SEED = 17
_FAN = 32  # sections a round: five bisections


def counted(docs: DataFrame, *carried) -> DataFrame:
    """``docs`` (doc_id, source, text) to (doc_id, source, n_tokens, mark, block, ...), ``carried`` too."""
    mark = F.xxhash64(F.col("doc_id").cast("long"), "text")
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        words.cast("long").alias("n_tokens"),
        mark.alias("mark"), F.pmod(F.xxhash64(F.lit(SEED), mark), F.lit(BLOCKS)).cast("int").alias("block"), *carried,
    )


def _curve(sources: DataFrame, total: float, alphas: list[float]) -> list[tuple[float, float, float]]:
    """(alpha, entropy in bits, largest weight over share) for each alpha, in one aggregation."""
    p = F.col("n") / F.lit(total)
    aggs = []
    for k, a in enumerate(alphas):
        x = F.pow(p, F.lit(a))
        aggs += [F.sum(x).alias(f"z{k}"), F.sum(x * F.log2(x)).alias(f"l{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{k}")]
    r = sources.agg(*aggs).first()
    import math

    return [(a, math.log2(r[f"z{k}"]) - r[f"l{k}"] / r[f"z{k}"], r[f"m{k}"] / r[f"z{k}"]) for k, a in enumerate(alphas)]


def _bisect(sources, total, lo: float, hi: float, good) -> float:
    """Least alpha in [lo, hi] at which ``good(entropy, ratio)`` holds; it holds at hi."""
    while hi - lo > 1e-9:
        step = (hi - lo) / _FAN
        grid = [lo + step * k for k in range(1, _FAN)]
        ok = [good(e, m) for _, e, m in _curve(sources, total, grid)]
        k = ok.index(True) if True in ok else len(grid)
        lo, hi = (grid[k - 1] if k else lo), (grid[k] if k < len(grid) else hi)
    return hi


def exponent(sources: DataFrame, budget: float, entropy_share: float, max_repeats: float) -> float:
    """alpha for sources (source, n): the target entropy, then the limit of repetition."""
    total, count = sources.agg(F.sum("n"), F.count("*")).first()
    total, even = float(total), float(count)
    import math

    target = entropy_share * math.log2(even) if even > 1 else 0.0
    ((_, top, ratio0), (_, least, ratio1)) = _curve(sources, total, [0.0, 1.0])
    if least >= target:
        alpha = 1.0  # the mix is even enough as it is
    elif top <= target:
        alpha = 0.0
    else:  # entropy falls with alpha: the least alpha at which it is down to the target
        alpha = _bisect(sources, total, 0.0, 1.0, lambda e, m: e <= target)
    over = lambda m: m * budget / total > max_repeats * (1 + 1e-9)
    if over(_curve(sources, total, [alpha])[0][2]):
        alpha = 1.0 if over(ratio1) else _bisect(sources, total, alpha, 1.0, lambda e, m: not over(m))
    return alpha


def mixed(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, row: str | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text) to the mix: (doc_id, source, epoch, n_tokens, mix_at).

    ``row``: a column that is carried along, to the result's last column.

    ``budget``: tokens of the mix; all tokens of ``docs`` by default.  Sorted by ``mix_at``, 0 to
    1, the rows interleave the sources at their weights.
    """
    rows = stored(counted(docs, *([row] if row else [])), "tokens")
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = stored(blocks.groupBy("source").agg(F.sum("tokens").alias("n")).filter("n > 0"), "sources")
    schema = "doc_id long, source string, epoch int, n_tokens long, mix_at double"
    total = sources.agg(F.sum("n")).first()[0]
    if not total:
        none = docs.sparkSession.createDataFrame([], schema)
        return none if row is None else none.withColumn(row, F.lit(None).cast(docs.schema[row].dataType))
    budget = budget or int(total)
    alpha = exponent(sources, budget, entropy_share, max_repeats)
    z = sources.agg(F.sum(F.pow(F.col("n") / total, F.lit(alpha)))).first()[0]
    want = F.floor(F.pow(F.col("n") / total, F.lit(alpha)) / z * budget + 1e-6).cast("long")
    plan = sources.withColumn("want", want).withColumn("epochs", F.floor(F.col("want") / F.col("n")).cast("int")).withColumn("rest", F.col("want") - F.col("epochs") * F.col("n"))

    last = F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)
    turns = blocks.join(plan, "source").filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(SEED), "source", "epoch", "block"), "block")
    turns = turns.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    partial = F.col("epoch") == F.col("epochs")
    turns = turns.filter(~partial | (F.col("before") < F.col("rest"))).withColumn("room", F.when(partial & (F.col("before") + F.col("tokens") > F.col("rest")), F.col("rest") - F.col("before")))
    turns = stored(turns.select("source", "block", "epoch", "before", "room", "tokens", (F.col("epoch") * F.col("n") + F.col("before")).alias("at"), "want"), "turns")

    inner = F.xxhash64(F.lit(SEED + 1), "epoch", "mark")
    spot = (F.col("at") + F.col("tokens") * (F.shiftrightunsigned(inner, 11) / F.lit(2.0 ** 53))) / F.col("want")
    out = ["doc_id", "source", "epoch", "n_tokens", F.least(spot, F.lit(1.0)).alias("mix_at"), *([row] if row else [])]
    full = rows.join(turns.filter("room is null"), ["source", "block"]).select(*out)
    within = Window.partitionBy("source", "block", "epoch").orderBy(inner, "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.join(turns.filter("room is not null"), ["source", "block"]).withColumn("used", F.sum("n_tokens").over(within)).filter("used <= room").select(*out)
    return full.unionByName(cut)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(_input(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, a row for each epoch they are in, each file in the mix's order."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # rows that come from no file
        docs = stored(docs, "documents")
    line = [F.xxhash64("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_line")]
    light = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"), F.struct(*line).alias("mix_row"))
    mix = mixed(light, row="mix_row").select("mix_row.mix_file", "mix_row.mix_line", "mix_at", "epoch")
    whole = docs.select(F.struct(*docs.columns).alias("mix_doc"), *line)
    out = whole.join(mix, ["mix_file", "mix_line"]).sortWithinPartitions("mix_at", "epoch", "mix_file", "mix_line")
    return out.select(*[F.col("mix_doc")[c].alias(c) for c in docs.columns])
