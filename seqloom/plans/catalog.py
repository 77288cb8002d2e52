"""The registered queries, each over whole tables, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClusterOptions, IndexOptions, SearchOptions, SeedPolicy
from ..functions import columns as C
from ..functions.udfs import codec, fnv1a64
from ..operators import candidates as cand
from ..operators import cascade, cluster, search
from ..operators.index import Index, hot_threshold, posting_lists, stats, with_tiers
from ..operators.profile import reject_rates
from ..operators.ranking import dense_index
from ..sources import fasta, sinks
from ..storage import scratch_dir, stored
from . import sql

FAST = ClusterOptions()
INDEX = IndexOptions()
SEARCH = SearchOptions()
BUDGET = SearchOptions(work_budget=16, max_df=64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of all documents as sequences (seq_id, name, seq)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), C.residues(F.coalesce("text", F.lit(""))).alias("seq"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of all pages outside tags, a second segment."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.residues(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")).alias("seq"))
    numbered = dense_index(pages, [F.asc("page_id")], "seq_id")
    return numbered.select("seq_id", F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("name"), "seq")


def query_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the documents whose id is divisible by 50."""
    return sequences(spark, sf_dir).filter("seq_id % 50 = 0").select(F.col("seq_id").alias("q"), F.col("name").alias("query_id"), "seq")


def built(spark: SparkSession, sf_dir: str, second: bool = False) -> Index:
    index = Index(spark, scratch_dir(spark, "index")).build(sequences(spark, sf_dir), INDEX, "protein", f"{sf_dir}/documents.parquet")
    return index.update(page_sequences(spark, sf_dir), INDEX, "protein", f"{sf_dir}/pages.parquet") if second else index


def hexed(c: str) -> F.Column:
    return C.hex64(F.col(c)).alias(c)


# ------------------------------------------------------------------ sources

@query(sql.with_(sql.SEQS, "SELECT seq_id, name, CAST(length(seq) AS INTEGER) AS seq_len, md5(seq) AS seq_md5 FROM s"))
def seq_ingest(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", "name", F.length("seq").alias("seq_len"), F.md5("seq").alias("seq_md5"))


@query(sql.with_(sql.SEQS, """SELECT 1 AS version, CASE WHEN coalesce(bool_and(regexp_full_match(seq, '[ACGTUNRYSWKMBDHV]*')), TRUE) THEN 'nucleotide' ELSE 'protein' END AS dbtype, count(*) AS n_seqs,
  CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS total_bases, CAST(coalesce(max(length(seq)), 0) AS INTEGER) AS max_seq_len, 'ascii_upper' AS encoding, 'little' AS endian FROM s"""))
def db_meta(spark, sf_dir):
    return fasta.meta(sequences(spark, sf_dir))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 7)[:26]


@query(sql.with_(sql.SEQS, f"""SELECT kind, CASE WHEN bool_and(regexp_full_match(x, '[ACGTUNRYSWKMBDHV]*')) THEN 'nucleotide' ELSE 'protein' END AS dbtype
  FROM (SELECT 'residues' AS kind, seq AS x FROM s UNION ALL SELECT 'recoded', translate(seq, '{_LETTERS}', '{_BASES}') FROM s) GROUP BY kind"""))
def dbtype_infer(spark, sf_dir):
    s = sequences(spark, sf_dir)
    both = s.select(F.lit("residues").alias("kind"), "seq").unionByName(s.select(F.lit("recoded").alias("kind"), F.translate("seq", _LETTERS, _BASES).alias("seq")))
    return both.groupBy("kind").agg(fasta.dbtype_of(both).alias("dbtype"))


@query(sql.with_(sql.SEQS, f"""SELECT seq_id, lower(hex(list_reduce(list_transform(string_split(seq, ''), lambda c: CAST(ascii(c) AS UBIGINT)),
    lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * 1099511628211::UHUGEINT) % {sql.MOD} AS UBIGINT), 14695981039346656037::UBIGINT))) AS checksum FROM s WHERE seq <> ''
  UNION ALL SELECT seq_id, lower(hex(14695981039346656037::UBIGINT)) FROM s WHERE seq = ''"""))
def fnv_checksum(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", C.hex64(fnv1a64("seq")).alias("checksum"))


_SCAN = sql.with_(sql.SEQS, "SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, name, md5(seq) AS seq_md5 FROM s")


def _scanned(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", "name", F.md5("seq").alias("seq_md5"))


def _files(spark: SparkSession, path: str) -> str:
    """The part files below a path, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return ",".join(sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-") and f.getLen() > 0))


def _fasta_files(spark, sf_dir: str, **options) -> str:
    path = scratch_dir(spark, "fasta")
    lower = F.concat(F.lower(F.substring("seq", 1, 7)), F.expr("substring(seq, 8)"))  # read in upper case again
    rows = sequences(spark, sf_dir).orderBy("seq_id").select(sinks.fasta_lines(F.col("name"), lower).alias("value"))
    rows.write.options(**options).text(path)
    return _files(spark, path)


@query(_SCAN)
def fasta_scan(spark, sf_dir):
    """The documents as FASTA files, wrapped at 60 letters, read in splits."""
    return _scanned(fasta.read_sequences(spark, _fasta_files(spark, sf_dir), "fasta", 1 << 18))


@query(_SCAN)
def gzip_scan(spark, sf_dir):
    """The same files compressed; the format is told by their first byte."""
    return _scanned(fasta.read_sequences(spark, _fasta_files(spark, sf_dir, compression="gzip")))


@query(_SCAN)
def fastq_scan(spark, sf_dir):
    path = scratch_dir(spark, "fastq")
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    sequences(spark, sf_dir).orderBy("seq_id").select(record.alias("value")).write.text(path)
    return _scanned(fasta.read_sequences(spark, _files(spark, path), "fastq"))


@query(sql.with_(sql.SEQS, f"""SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, name, CAST(length(seq) AS INTEGER) AS seq_len, md5(seq) AS seq_md5, bool_and(regexp_full_match(seq, '[ACGTUNRYSWKMBDHV]*')) OVER () AS nucleotide FROM s"""))
def createdb(spark, sf_dir):
    """A database made from FASTA files: its sequences, and the type in its metadata."""
    db = scratch_dir(spark, "db")
    meta = fasta.createdb(spark, _fasta_files(spark, sf_dir), db)
    return fasta.load_db(spark, db).select("seq_id", "name", "seq_len", F.md5("seq").alias("seq_md5"), F.lit(meta["dbtype"] == "nucleotide").alias("nucleotide"))


# ------------------------------------------------------------------ seeds and postings

@query(sql.with_(sql.seeds(INDEX.k, INDEX.m, False), "SELECT seq_id, lower(hex(hash)) AS hash, CAST(pos AS INTEGER) AS pos FROM sd"))
def kmer_seeds(spark, sf_dir):
    return cand.kmer_seeds(sequences(spark, sf_dir), INDEX.k, INDEX.m, False).select("seq_id", hexed("hash"), "pos")


@query(sql.with_(sql.seeds(10, 20, True), "SELECT seq_id, lower(hex(hash)) AS hash, CAST(pos AS INTEGER) AS pos FROM sd"))
def kmer_seeds_reduced(spark, sf_dir):
    return cand.kmer_seeds(sequences(spark, sf_dir), 10, 20, True).select("seq_id", hexed("hash"), "pos")


def _members(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return cand.group_members(cand.kmer_seeds(s, FAST.kmer_size, FAST.seeds_per_seq, FAST.reduced))


@query(sql.with_(sql.groups(FAST), "SELECT lower(hex(hash)) AS hash, cnt AS n, leader, CAST(leader_len AS INTEGER) AS leader_len FROM gs"))
def kmer_group_stats(spark, sf_dir):
    return cand.group_stats(_members(spark, sf_dir)).select(hexed("hash"), "n", "leader", "leader_len")


@query(sql.with_(sql.postings(INDEX), "SELECT lower(hex(key)) AS key, df, array_to_string(ids, ',') AS seq_ids FROM ps"))
def postings_build(spark, sf_dir):
    return posting_lists(sequences(spark, sf_dir), INDEX).select(hexed("key"), "df", F.concat_ws(",", F.transform("seq_ids", lambda x: x.cast("string"))).alias("seq_ids"))


_RANK = "CAST(round(CAST(n_keys - 1 AS FLOAT) * CAST({} AS FLOAT)) AS BIGINT) + 1"


@query(sql.with_(sql.postings(INDEX), f"""SELECT 1 AS version, 0 AS segment_id, (SELECT count(*) FROM s) AS n_seqs, n_keys, lower(hex(lo)) AS min_key, lower(hex(hi)) AS max_key,
  (SELECT df FROM (SELECT df, row_number() OVER (ORDER BY df) AS r FROM ps) WHERE r = {_RANK.format(0.5)}) AS df_p50,
  (SELECT df FROM (SELECT df, row_number() OVER (ORDER BY df) AS r FROM ps) WHERE r = {_RANK.format(0.9)}) AS df_p90, df_max
  FROM (SELECT count(*) AS n_keys, min(key) AS lo, max(key) AS hi, max(df) AS df_max FROM ps)"""))
def df_stats(spark, sf_dir):
    s = sequences(spark, sf_dir)
    lists = stored(posting_lists(s, INDEX).select(F.lit(0).alias("segment_id"), "key", "df"), "postings")
    return stats(lists, s.agg(F.count("*").alias("n_seqs")).select(F.lit(0).alias("segment_id"), "n_seqs"))


@query(sql.with_(sql.postings(INDEX), "SELECT lower(hex(key)) AS key, df, CASE WHEN df >= greatest((SELECT count(*) FROM s) // 64, 32) THEN 'hot' ELSE 'cold' END AS tier FROM ps"))
def tier_assign(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return with_tiers(posting_lists(s, INDEX), hot_threshold(s.count(), None)).select(hexed("key"), "df", "tier")


_GAPS = sql.gaps("ids")


@query(sql.with_(sql.postings(INDEX), f"""SELECT lower(hex(key)) AS key, df, CAST({sql.vbyte_size(_GAPS)} AS INTEGER) AS bytes_vbyte, CAST({sql.vbyte_size(_GAPS)} + (df + 3) // 4 AS INTEGER) AS bytes_delta_varint,
  CAST({sql.bp128_size(_GAPS)} AS INTEGER) AS bytes_bp128, TRUE AS same_vbyte, TRUE AS same_delta_varint, TRUE AS same_bp128 FROM ps"""))
def codec_roundtrip(spark, sf_dir):
    """Posting lists through the three codecs: their sizes, and whether they come back whole."""
    lists = stored(posting_lists(sequences(spark, sf_dir), INDEX).select("key", "df", "seq_ids"), "postings")
    out = lists
    for name in ("vbyte", "delta_varint", "bp128"):
        out = out.withColumn(f"e_{name}", codec(name, True)("seq_ids"))
    same = [codec(n, False)(f"e_{n}").alias(f"d_{n}") for n in ("vbyte", "delta_varint", "bp128")]
    back = out.select("*", *same)
    return back.select(hexed("key"), "df", *[F.length(f"e_{n}").alias(f"bytes_{n}") for n in ("vbyte", "delta_varint", "bp128")], *[(F.col(f"d_{n}") == F.col("seq_ids")).alias(f"same_{n}") for n in ("vbyte", "delta_varint", "bp128")])


# ------------------------------------------------------------------ pairs and filters

def _pairs(spark, sf_dir):
    return cand.candidate_pairs(_members(spark, sf_dir))


@query(sql.with_(sql.pairs(FAST), "SELECT rep, member, CAST(rep_len AS INTEGER) AS rep_len, CAST(member_len AS INTEGER) AS member_len FROM pr"))
def candidate_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_LOSS = sql._f(1 - FAST.thresholds.prefilter_identity)


@query(sql.with_(sql.judged(FAST), "SELECT rep, member, CAST(mm AS INTEGER) AS mismatches, reject IS DISTINCT FROM 'hamming' AS passed FROM jd"))
def hamming_filter(spark, sf_dir):
    rows = cascade.screened(_pairs(spark, sf_dir), sequences(spark, sf_dir), FAST)
    return rows.select("rep", "member", "mismatches", (F.coalesce("reject", F.lit("")) != "hamming").alias("passed"))


@query(sql.with_(sql.pairs(FAST), f"SELECT rep, member, {', '.join(f'({sql._cov(m, 0.8)}) AS mode{m}' for m in range(4))} FROM pr"))
def coverage_modes(spark, sf_dir):
    ok = [C.coverage_possible(F.col("member_len"), F.col("rep_len"), 0.8, m).alias(f"mode{m}") for m in range(4)]
    return _pairs(spark, sf_dir).select("rep", "member", *ok)


@query(sql.with_(sql.judged(FAST), f"""SELECT rep, member, least(rep_len, member_len) > 0 AND CAST(least(rep_len, member_len) AS FLOAT) / CAST(greatest(rep_len, member_len) AS FLOAT) >= {sql._f(0.8)}
  AND mm <= greatest(floor({sql._f(1 - __import__('numpy').float32(0.9))} * CAST(least(rep_len, member_len) AS FLOAT)), 0) AND CAST(least(rep_len, member_len) - mm AS FLOAT) / CAST(least(rep_len, member_len) AS FLOAT) >= {sql._f(0.9)} AS passed FROM jd"""))
def ungapped_filter(spark, sf_dir):
    rows = cascade.screened(_pairs(spark, sf_dir), sequences(spark, sf_dir), FAST)
    ok = C.ungapped_ok(F.col("mismatches"), F.least("rep_len", "member_len"), F.greatest("rep_len", "member_len"), 0.9, 0.8)
    return rows.select("rep", "member", F.coalesce(ok, F.lit(False)).alias("passed"))


@query(sql.with_(sql.judged(FAST), "SELECT rep, member, CAST(mm AS INTEGER) AS mismatches, coalesce(reject, 'none') AS reject FROM jd"))
def cascade_fast(spark, sf_dir):
    rows = cascade.evaluated(_pairs(spark, sf_dir), sequences(spark, sf_dir), FAST)
    return rows.select("rep", "member", "mismatches", F.coalesce("reject", F.lit("none")).alias("reject"))


# ------------------------------------------------------------------ clustering

@query(sql.with_(sql.clusters(FAST), "SELECT cluster_id, rep_id, member_id FROM cl"))
def cluster_fast(spark, sf_dir):
    return cluster.cluster(sequences(spark, sf_dir), FAST)


def _level(level):
    def run(spark, sf_dir):
        return cluster.cluster(sequences(spark, sf_dir), ClusterOptions(level=level))

    return run


for _name in ("medium", "sensitive", "ultra"):
    QUERIES[f"cluster_{_name}"] = _level(_name)


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


@query(sql.with_(sql.counters(FAST), f"""SELECT *, {_share('hamming_rejected', 'candidate_pairs_evaluated')} AS hamming_rate, {_share('ungapped_rejected', '(candidate_pairs_evaluated - hamming_rejected)')} AS ungapped_rate, 0.0::DOUBLE AS gapped_rate
  FROM (SELECT (SELECT count(*) FROM sd) AS seeds_generated, (SELECT count(DISTINCT hash) FROM sd) AS unique_kmers, (SELECT n FROM rd) AS total_posting_length_read, count(*) AS candidate_pairs_evaluated,
  count(*) FILTER (reject = 'hamming') AS hamming_rejected, count(*) FILTER (reject = 'ungapped') AS ungapped_rejected, CAST(0 AS BIGINT) AS gapped_rejected, count(*) FILTER (reject IS NULL) AS assigned_pairs FROM ev)"""))
def cluster_counters(spark, sf_dir):
    return reject_rates(cluster.counters(sequences(spark, sf_dir), FAST))


@query(sql.with_(sql.clusters(FAST), "SELECT cluster_id, s.name, md5(s.seq) AS seq_md5 FROM cl JOIN s ON s.seq_id = rep_id WHERE rep_id = member_id"))
def rep_seqs(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return cluster.representatives(cluster.cluster(s, FAST), s).select("cluster_id", "name", F.md5("seq").alias("seq_md5"))


@query(sql.with_(sql.clusters(FAST), "SELECT rep_id, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS total_chars, count(DISTINCT lang) AS langs FROM cl JOIN documents ON doc_id = member_id GROUP BY rep_id"))
def cluster_summary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("member_id"), "lang", "n_chars")
    return cluster_fast(spark, sf_dir).join(docs, "member_id").groupBy("rep_id").agg(F.count("*").alias("members"), F.sum("n_chars").alias("total_chars"), F.countDistinct("lang").alias("langs"))


_RECALL = sql.with_(sql.clusters(FAST), """, ex AS (SELECT min(seq_id) OVER (PARTITION BY seq) AS w, seq_id FROM s), hit AS (SELECT sum(c * (c - 1) / 2) AS hit FROM (SELECT count(*) AS c FROM cl JOIN ex ON ex.seq_id = member_id GROUP BY cluster_id, w)),
al AS (SELECT sum(c * (c - 1) / 2) AS total FROM (SELECT count(*) AS c FROM ex GROUP BY w))
SELECT CAST(total AS BIGINT) AS wanted_pairs, CAST(hit AS BIGINT) AS found_pairs, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE CAST(hit AS DOUBLE) / CAST(total AS DOUBLE) END AS recall FROM hit, al""").replace("\n, ex", ", ex")


@query(_RECALL)
def pairwise_recall(spark, sf_dir):
    """Exact copies that the clustering puts together."""
    s = sequences(spark, sf_dir)
    keyed = s.select("seq_id", F.md5("seq").alias("key"), F.length("seq").alias("n"))  # 128 bits and the length
    groups = keyed.groupBy("key", "n").agg(F.min("seq_id").alias("cluster_id"))
    wanted = keyed.join(groups, ["key", "n"]).select("cluster_id", F.col("seq_id").alias("member_id"))
    return cluster.pairwise_recall(cluster.cluster(s, FAST), wanted)


# ------------------------------------------------------------------ index and search

_QSEEDS = sql.postings(INDEX) + f""",
qs AS (SELECT seq_id AS q, hash, pos, xor(hash, {INDEX.seed}::UBIGINT) AS key FROM sd WHERE seq_id % 50 = 0),
qd AS (SELECT qs.*, coalesce(ps.df, 4294967295) AS df FROM qs LEFT JOIN ps ON ps.key = qs.key),
qt AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY df) AS r, count(*) OVER (PARTITION BY q) AS n FROM qd),
th AS (SELECT q, max(df) FILTER (r = least(CAST(round(CAST(n - 1 AS FLOAT) * CAST(0.9 AS FLOAT)) AS BIGINT), n - 1) + 1) AS cut FROM qt GROUP BY q),
sl AS (SELECT * FROM (SELECT qd.*, row_number() OVER (PARTITION BY qd.q ORDER BY df, hash, pos) AS rnk FROM qd JOIN th ON th.q = qd.q WHERE df <= cut) WHERE rnk <= 128)"""


@query(sql.with_(_QSEEDS, "SELECT q, lower(hex(hash)) AS hash, CAST(pos AS INTEGER) AS pos, CAST(df AS BIGINT) AS df, rnk AS rank FROM sl"))
def seed_df_prune(spark, sf_dir):
    lists = posting_lists(sequences(spark, sf_dir), INDEX).select("key", "df")
    seeds = stored(search.query_seeds(query_sequences(spark, sf_dir), SEARCH), "query-seeds")
    kept = search.pruned_seeds(search.seed_frequencies(seeds, lists), SEARCH)
    return kept.select("q", hexed("hash"), "pos", "df", "rank")


_WORK = _QSEEDS + f""",
pb AS (SELECT sl.q, sl.key, rnk, ps.df, ps.df <= {BUDGET.max_df} AS live FROM sl JOIN ps ON ps.key = sl.key),
bw AS (SELECT *, coalesce(sum(CASE WHEN live THEN df ELSE 0 END) OVER p, 0) AS work, coalesce(max(CAST(live AS INTEGER)) OVER p, 0) AS started FROM pb WINDOW p AS (PARTITION BY q ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bk AS (SELECT * FROM bw WHERE NOT (started = 1 AND work >= {BUDGET.work_budget})),
bt AS (SELECT q, sum(CASE WHEN live THEN df ELSE 0 END) AS total, count(*) AS found FROM bk GROUP BY q),
bn AS (SELECT q, count(*) AS n FROM sl GROUP BY q)"""


@query(sql.with_(_WORK, f"""SELECT bk.q, lower(hex(key)) AS key, rnk AS rank, CAST(df AS BIGINT) AS df FROM bk JOIN bt ON bt.q = bk.q JOIN bn ON bn.q = bk.q
  WHERE live AND NOT (total > {4 * BUDGET.work_budget} AND found <= greatest(1, n // 10))"""))
def work_budget_prefix(spark, sf_dir):
    """Keys that a search of one segment reads within a work budget."""
    index = built(spark, sf_dir)
    kept = search.selected_seeds(query_sequences(spark, sf_dir), index, BUDGET)
    return search.probed(kept, index.matched(kept), index.segments(), BUDGET).select("q", hexed("key"), "rank", "df")


def _candidates(spark, sf_dir, second=False):
    index = built(spark, sf_dir, second)
    seeds = search.selected_seeds(query_sequences(spark, sf_dir), index, SEARCH)
    return search.candidates(search.probed(seeds, index.lists(seeds), index.segments(), SEARCH), SEARCH)


@query(sql.with_(_QSEEDS, """, ex AS (SELECT sl.q, unnest(ids) AS local_id, sl.key, greatest(1, CAST(round(CAST(ln(CAST((SELECT count(*) FROM s) + 1 AS FLOAT) / CAST(ps.df + 1 AS FLOAT)) AS FLOAT) * 1024) AS INTEGER)) AS w FROM sl JOIN ps ON ps.key = sl.key)
SELECT q, local_id, count(*) AS seed_hits, CAST(sum(w) AS BIGINT) AS weight, array_to_string(list_transform(list_slice(list_sort(list(DISTINCT key)), 1, 4), lambda x: lower(hex(x))), ',') AS keys FROM ex GROUP BY q, local_id""").replace("\n, ex", ", ex"))
def search_candidates(spark, sf_dir):
    keys = F.concat_ws(",", F.transform("keys", lambda x: C.hex64(C.unsigned(x)))).alias("keys")
    return _candidates(spark, sf_dir).select("q", "local_id", "seed_hits", "weight", keys)


@query()
def search_topk(spark, sf_dir):
    """Ranked hits in two segments."""
    index = built(spark, sf_dir, True)
    return search.search(index, query_sequences(spark, sf_dir), SEARCH).select("query_id", "rank", "target_id", "score", F.col("identity").cast("double").alias("identity"), F.col("coverage").cast("double").alias("coverage"), "seed_hits", "segment_id", "explain", "target_name", "local_id")


@query()
def search_stats(spark, sf_dir):
    index = built(spark, sf_dir)
    queries = query_sequences(spark, sf_dir)
    return search.search_stats(queries, search.search(index, queries, SEARCH))


@query("""WITH d AS (SELECT count(*) AS n FROM documents), p AS (SELECT count(*) AS n FROM pages)
SELECT 0 AS segment_id, d.n AS n_seqs, CAST(0 AS BIGINT) AS global_seq_base FROM d UNION ALL SELECT 1, p.n, d.n FROM d, p""")
def segment_append(spark, sf_dir):
    return built(spark, sf_dir, True).segments().select("segment_id", "n_seqs", "global_seq_base")


@query("""WITH d AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS global_id, 0 AS segment_id, doc_id AS local_id FROM documents UNION ALL SELECT d.n + r, 1, r FROM (SELECT row_number() OVER (ORDER BY page_id) - 1 AS r FROM pages), d""")
def global_id_resolve(spark, sf_dir):
    index = built(spark, sf_dir, True)
    return index.resolve(index.with_global_ids().select("global_id"))


_INFO = sql.segments(INDEX) + """,
sz AS (SELECT seg, CAST(sum({size}) AS BIGINT) AS posting_bytes, count(*) FILTER (df >= greatest(n_seqs // 64, 32)) AS hot_keys FROM ps JOIN sg USING (seg) GROUP BY seg)"""


@query(sql.with_(_INFO.replace("{size}", sql.bp128_size(_GAPS)), f"""SELECT segment_id, {INDEX.k} AS k, {INDEX.m} AS m, CAST({INDEX.seed} AS BIGINT) AS seed, n_seqs, CASE WHEN segment_id = 0 THEN CAST(0 AS BIGINT) ELSE (SELECT n_seqs FROM sg WHERE seg = 0) END AS global_seq_base,
  'protein' AS dbtype, greatest(n_seqs // 64, 32) AS hot_df_threshold, '{INDEX.hot_mode}' AS hot_mode, '{INDEX.codec}' AS codec, n_keys, min_key, max_key, df_p50, df_p90, df_max, posting_bytes, hot_keys FROM tn LEFT JOIN sz ON seg = segment_id"""))
def index_info(spark, sf_dir):
    """Options, sizes and statistics of two segments; their fingerprints are left out, as SQL has no such hash."""
    return built(spark, sf_dir, True).info().drop("db_path", "db_fingerprint")


@query(sql.with_(sql.clusters(FAST), "SELECT CAST(cluster_id AS VARCHAR) || chr(9) || rep_id || chr(9) || member_id AS line FROM cl"))
def clusters_tsv(spark, sf_dir):
    """The cluster table as its sink writes it, read back."""
    path = scratch_dir(spark, "clusters-tsv")
    sinks.write_clusters(cluster_fast(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(sql.with_(sql.clusters(FAST), "SELECT cluster_id, count(*) AS members, array_to_string(list(member_id ORDER BY member_id), ',') AS member_ids FROM cl GROUP BY cluster_id"))
def cluster_members(spark, sf_dir):
    """Members of each cluster in order; a cluster's list is at most its group of similar texts."""
    ids = F.transform(F.sort_array(F.collect_list("member_id")), lambda x: x.cast("string"))
    return cluster_fast(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("members"), F.concat_ws(",", ids).alias("member_ids"))


@query(sql.with_(sql.clusters(FAST), r"SELECT cluster_id, md5('>' || s.name || CASE WHEN s.seq = '' THEN '' ELSE chr(10) || array_to_string(list_transform(range(0, length(s.seq), 60), lambda i: substr(s.seq, CAST(i + 1 AS BIGINT), 60)), chr(10)) END) AS record_md5 FROM cl JOIN s ON s.seq_id = rep_id WHERE rep_id = member_id"))
def rep_fasta(spark, sf_dir):
    """FASTA records of the representatives, wrapped at 60 letters."""
    s = sequences(spark, sf_dir)
    reps = cluster.representatives(cluster.cluster(s, FAST), s)
    return reps.select("cluster_id", F.md5(sinks.fasta_lines(F.col("name"), F.col("seq"))).alias("record_md5"))


@query(sql.with_(sql.seeds(10, 20, True), "SELECT count(*) AS seeds, count(DISTINCT hash) AS unique_kmers, count(DISTINCT seq_id) AS seeded_sequences FROM sd"))
def kmer_totals(spark, sf_dir):
    return cand.kmer_seeds(sequences(spark, sf_dir), 10, 20, True).agg(F.count("*").alias("seeds"), F.countDistinct("hash").alias("unique_kmers"), F.countDistinct("seq_id").alias("seeded_sequences"))


@query(sql.with_(sql.SEQS, "SELECT seq_id, CASE WHEN length(seq) < 80 THEN 13 ELSE 14 END AS k FROM s"))
def query_k_policy(spark, sf_dir):
    """k of each sequence as a query under a variable-k policy."""
    policy = SeedPolicy.named("variable_k", INDEX.k, INDEX.m)
    return sequences(spark, sf_dir).select("seq_id", C.choose_k(policy, INDEX.k, F.length("seq")).alias("k"))


NUCLEOTIDE = ClusterOptions(dbtype="nucleotide")
_RECODED = sql.SEQS.replace("upper(", "translate(upper(").replace("'g'))", f"'g')), '{_LETTERS}', '{_BASES}')")


@query(sql.with_(sql.clusters(NUCLEOTIDE).replace(sql.SEQS, _RECODED), "SELECT cluster_id, rep_id, member_id FROM cl"))
def cluster_nucleotide(spark, sf_dir):
    """Clusters of the documents recoded as nucleotides: k-mers of 15, exact alphabet."""
    s = sequences(spark, sf_dir).withColumn("seq", F.translate("seq", _LETTERS, _BASES))
    return cluster.cluster(s, NUCLEOTIDE)


@query()
def hits_tsv(spark, sf_dir):
    """Lines of the hit file, in the order of queries and ranks."""
    path = scratch_dir(spark, "hits-tsv")
    index = built(spark, sf_dir, True)
    sinks.write_hits(search.search(index, query_sequences(spark, sf_dir), SEARCH), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(sql.with_(sql.segments(INDEX), "SELECT 1 AS version, * FROM tn"))
def index_tune(spark, sf_dir):
    """Statistics of both segments, recounted and stored; the seed policy becomes the general one."""
    return built(spark, sf_dir, True).tune()
