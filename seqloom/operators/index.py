"""A persistent inverted index of k-mers in segments, as Parquet tables.

``sequences`` (segment_id, local_id, name, seq, seq_len), ``postings`` (segment_id, key, df, tier,
seq_ids), both partitioned by segment, and ``segments`` with one row for each segment, whose
writing commits it.  Keys are 64-bit hashes xor the index's seed, in two's complement.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexOptions, SeedPolicy
from ..errors import SeqError
from ..functions import columns as C
from ..functions.udfs import codec, decoded, seed_rows
from ..storage import stored

SEGMENTS = "version int, segment_id int, db_path string, db_fingerprint long, k int, m int, seed long, n_seqs long, global_seq_base long, dbtype string, hot_df_threshold long, hot_mode string, codec string"
SEQUENCES = "local_id long, name string, seq string, seq_len int, segment_id int"
POSTINGS = "key long, df long, tier string, encoded binary, segment_id int"
STATS = "version int, segment_id int, n_seqs long, n_keys long, min_key string, max_key string, df_p50 long, df_p90 long, df_max long"


def posting_lists(seqs: DataFrame, opts: IndexOptions) -> DataFrame:
    """(key, df, seq_ids): the sequences of each key, once each and in order."""
    keyed = seed_rows(seqs, opts.k, opts.m, False).filter("not again").select(F.col("hash").bitwiseXOR(F.lit(C.signed64(opts.seed))).alias("key"), "seq_id")
    return keyed.groupBy("key").agg(F.count("*").alias("df"), F.sort_array(F.collect_list("seq_id")).alias("seq_ids"))


def hot_threshold(n_seqs: int, wanted: int | None) -> int:
    return wanted if wanted is not None else max(n_seqs // 64, 32)


def with_tiers(postings: DataFrame, threshold: int) -> DataFrame:
    return postings.withColumn("tier", F.when(F.col("df") >= threshold, "hot").otherwise("cold"))


def stats(postings: DataFrame, n_seqs) -> DataFrame:
    """STATS of posting lists (segment_id, key, df); quantiles are exact ranks.

    Ranks come from counts of each document frequency: a few rows, whatever the number of keys.
    """
    base = postings.groupBy("segment_id").agg(F.count("*").alias("n_keys"), F.min(C.unsigned(F.col("key"))).alias("lo"), F.max(C.unsigned(F.col("key"))).alias("hi"), F.max("df").alias("df_max"))
    freq = postings.groupBy("segment_id", "df").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy("segment_id").orderBy("df"))
    ranked = freq.withColumn("upto", upto).join(base.select("segment_id", "n_keys"), "segment_id")
    at = lambda q: F.min(F.when(F.col("upto") > C.rank_at(F.col("n_keys"), q), F.col("df")))
    qs = ranked.groupBy("segment_id").agg(at(0.50).alias("df_p50"), at(0.90).alias("df_p90"))
    return (
        n_seqs.join(base, "segment_id", "left").join(qs, "segment_id", "left")
        .select(
            F.lit(1).alias("version"), "segment_id", "n_seqs", F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"),
            F.coalesce(C.hex64(C.unsigned(F.col("lo"))), F.lit("0")).alias("min_key"), F.coalesce(C.hex64(C.unsigned(F.col("hi"))), F.lit("0")).alias("max_key"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("df_p50", "df_p90", "df_max")],
        )
    )


#: Keys that are shipped to all tasks to pick their posting rows: 64 MB at most.
SHIPPED_KEYS = 8_000_000


def matched(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``postings`` whose key is among ``keys`` (key).

    Up to SHIPPED_KEYS keys go to where the postings are; more are joined by a shuffle of both.  The
    index itself is never shipped.
    """
    keys = keys.select("key").distinct()
    return postings.join(F.broadcast(keys) if keys.count() <= SHIPPED_KEYS else keys.hint("merge"), "key", "left_semi")


class Index:
    """An index below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -------------------------------------------------------------- tables
    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def segments(self) -> DataFrame:
        if not self.exists():
            raise SeqError("io", f"no index at {self.path}")
        return self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments")

    def rows(self) -> list:
        """Rows of ``segments``: one for each build or update, by id."""
        return sorted(self.segments().collect(), key=lambda r: r["segment_id"])

    def sequences(self) -> DataFrame:
        return self.spark.read.schema(SEQUENCES).parquet(f"{self.path}/sequences")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def with_global_ids(self) -> DataFrame:
        base = F.broadcast(self.segments().select("segment_id", "global_seq_base"))  # a row a segment
        return self.sequences().join(base, "segment_id").withColumn("global_id", F.col("global_seq_base") + F.col("local_id"))

    def policy(self) -> SeedPolicy | None:
        try:
            raw = self.spark.read.text(f"{self.path}/seed_policy.json", wholetext=True).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        d = json.loads(raw[0])
        return SeedPolicy(d["mode"], tuple(d["k_values"]), d["m"], d["short_query_use_k"], d["long_query_use_k"])

    def save_policy(self, p: SeedPolicy) -> None:
        text = json.dumps({"mode": p.mode, "k_values": list(p.k_values), "m": p.m, "short_query_use_k": p.short_k, "long_query_use_k": p.long_k})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/seed_policy.json")

    # -------------------------------------------------------------- writing
    def _segment(self, seqs: DataFrame, opts: IndexOptions, segment_id: int, base: int, dbtype: str, db_path: str, mode: str) -> None:
        opts.check()
        body = seqs.select(F.lit(segment_id).alias("segment_id"), F.col("seq_id").alias("local_id"), "name", "seq", F.length("seq").cast("int").alias("seq_len"))
        self._write("sequences", body, segment_id, mode)
        own = self.sequences().filter(F.col("segment_id") == segment_id)  # what was made once is read from here on
        n, print_ = own.agg(F.count("*"), F.bit_xor(F.xxhash64("local_id", "name", "seq"))).first()
        lists = with_tiers(posting_lists(own.withColumnRenamed("local_id", "seq_id"), opts), hot_threshold(n, opts.hot_df))
        out = lists.select(F.lit(segment_id).alias("segment_id"), "key", F.col("df").cast("long").alias("df"), "tier", codec(opts.codec, True)("seq_ids").alias("encoded"))
        self._write("postings", out.repartitionByRange(C.unsigned(F.col("key"))).sortWithinPartitions(C.unsigned(F.col("key"))), segment_id, mode)
        row = (1, segment_id, db_path, print_ or 0, opts.k, opts.m, C.signed64(opts.seed), n, base, dbtype, hot_threshold(n, opts.hot_df), opts.hot_mode, opts.codec)
        self.spark.createDataFrame([row], SEGMENTS).coalesce(1).write.mode(mode).parquet(f"{self.path}/segments")

    def _write(self, name: str, df: DataFrame, segment_id: int, mode: str) -> None:
        self._drop_segment(name, segment_id)
        df.write.mode(mode).partitionBy("segment_id").parquet(f"{self.path}/{name}")

    def _drop_segment(self, name: str, segment_id: int) -> None:
        """Remove what an update that failed before its commit may have left."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/segment_id={segment_id}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def build(self, seqs: DataFrame, opts: IndexOptions = IndexOptions(), dbtype: str = "protein", db_path: str = "", policy: SeedPolicy | None = None) -> "Index":
        """Segment 0; what the path held before goes."""
        self._segment(seqs, opts, 0, 0, dbtype, db_path, "overwrite")
        self.save_policy(policy or SeedPolicy("fixed_k", (max(opts.k - 1, 1), opts.k, opts.k + 1), opts.m, max(opts.k - 1, 1), opts.k))
        return self

    def update(self, seqs: DataFrame, opts: IndexOptions = IndexOptions(), dbtype: str = "protein", db_path: str = "") -> "Index":
        """Append a segment: next id, global ids after all others.  Options aren't compared here."""
        rows = self.rows()
        next_id = max((r["segment_id"] for r in rows), default=-1) + 1
        base = max((r["global_seq_base"] + r["n_seqs"] for r in rows), default=0)
        self._segment(seqs, opts, next_id, base, dbtype, db_path, "append")
        return self

    def tune(self, mode: str | None = None) -> DataFrame:
        """Recount the statistics; the seed policy goes back to the general one (of ``mode``)."""
        out = stored(self.stats(), "stats")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats")
        self.save_policy(SeedPolicy(mode or "fixed_k"))
        return out

    def stats(self) -> DataFrame:
        return stats(self.postings(), self.segments().select("segment_id", "n_seqs"))

    def info(self) -> DataFrame:
        """A row for each segment: its options, sizes and statistics."""
        size = self.postings().groupBy("segment_id").agg(F.sum(F.length("encoded")).alias("posting_bytes"), F.sum((F.col("tier") == "hot").cast("long")).alias("hot_keys"))
        return self.segments().drop("version").join(self.stats().drop("version", "n_seqs"), "segment_id").join(size, "segment_id", "left")

    def matched(self, keys: DataFrame) -> DataFrame:
        """Posting rows, still encoded, of the ``keys`` (key) alone."""
        return matched(self.postings(), keys)

    def lists(self, keys: DataFrame) -> DataFrame:
        """Decoded posting lists (segment_id, key, df, tier, seq_ids) of the ``keys`` (key), each decoded once."""
        names = F.broadcast(self.segments().select("segment_id", "codec"))  # a row a segment
        return decoded(self.matched(keys).join(names, "segment_id"))

    def search(self, queries: DataFrame, opts) -> DataFrame:
        """Ranked hits of ``queries`` (q, query_id, seq)."""
        from .search import search

        return search(self, queries, opts)

    def resolve(self, ids: DataFrame) -> DataFrame:
        """``ids`` (global_id) to (global_id, segment_id, local_id): a range join with the segments."""
        s = F.broadcast(self.segments().select("segment_id", "global_seq_base", "n_seqs"))
        g = F.col("global_id")
        return ids.join(s, (g >= F.col("global_seq_base")) & (g < F.col("global_seq_base") + F.col("n_seqs"))).select("global_id", "segment_id", (g - F.col("global_seq_base")).alias("local_id"))

