"""The registered queries as SQL for a single-node engine, built from shared parts."""
from __future__ import annotations

from ..config import ClusterOptions, IndexOptions
from ..functions.kernels import FMIX_1, FMIX_2, REDUCED, ROLL_BASE, ROLL_SEED
from ..operators.candidates import CLIQUE, LARGEST

MOD = "18446744073709551616::UHUGEINT"

SEQS = """s AS (SELECT doc_id AS seq_id, 'doc' || doc_id AS name, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS seq FROM documents)"""
LENS = "l AS (SELECT seq_id, length(seq) AS n FROM s)"


def _mul(x: str, c: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {c}::UHUGEINT) % {MOD} AS UBIGINT)"


def seeds(k: int, m: int, reduce: bool) -> str:
    """CTEs up to sd(seq_id, pos, hash): the bottom-m seeds, hash as UBIGINT."""
    if reduce:
        cls = " ".join(f"WHEN position(c IN '{letters}') > 0 THEN {n + 1}" for letters, n in REDUCED.items())
        value = f"CASE WHEN c IN ('N', 'X') THEN NULL {cls} ELSE 7 END"
    else:
        value = "CASE WHEN c IN ('N', 'X') THEN NULL ELSE ascii(c) + 1 END"
    window = " + ".join(f"CAST(lead(v, {j}) OVER w AS UHUGEINT) * {pow(ROLL_BASE, k - 1 - j, 1 << 64)}::UHUGEINT" for j in range(k))
    start = ROLL_SEED * pow(ROLL_BASE, k, 1 << 64) % (1 << 64)
    return f"""
lo(i, p) AS (SELECT 0, 1::UHUGEINT UNION ALL SELECT i + 1, (p * {ROLL_BASE}::UHUGEINT) % {MOD} FROM lo WHERE i < 255),
hi(i, p) AS (SELECT 0, {start}::UHUGEINT UNION ALL SELECT i + 1, (p * {pow(ROLL_BASE, 256, 1 << 64)}::UHUGEINT) % {MOD} FROM hi WHERE i < 1023),
{SEQS}, {LENS},
ch AS (SELECT seq_id, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS c FROM s WHERE length(seq) >= {k}),
vl AS (SELECT seq_id, pos, {value} AS v FROM ch),
rw AS (SELECT seq_id, pos, ({window}) % {MOD} AS h FROM vl WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
r0 AS (SELECT seq_id, pos, CAST((h + (lo.p * hi.p) % {MOD}) % {MOD} AS UBIGINT) AS h FROM rw JOIN lo ON lo.i = pos % 256 JOIN hi ON hi.i = pos // 256 WHERE h IS NOT NULL),
r1 AS (SELECT seq_id, pos, {_mul("xor(h, h >> 33)", FMIX_1)} AS h FROM r0),
r2 AS (SELECT seq_id, pos, {_mul("xor(h, h >> 33)", FMIX_2)} AS h FROM r1),
r3 AS (SELECT seq_id, pos, xor(h, h >> 33) AS hash FROM r2),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY hash, pos) AS rk FROM r3) WHERE rk <= {m})"""


def groups(o: ClusterOptions) -> str:
    return seeds(o.kmer_size, o.seeds_per_seq, o.reduced) + f""",
mb AS (SELECT DISTINCT hash, sd.seq_id, n FROM sd JOIN l ON sd.seq_id = l.seq_id),
gs AS (SELECT hash, count(*) AS cnt, arg_max(seq_id, (n, -seq_id)) AS leader, max(n) AS leader_len FROM mb GROUP BY hash HAVING count(*) BETWEEN 2 AND {LARGEST})"""


def pairs(o: ClusterOptions) -> str:
    return groups(o) + f""",
pr AS (SELECT a.seq_id AS rep, b.seq_id AS member, a.n AS rep_len, b.n AS member_len FROM mb a JOIN gs ON a.hash = gs.hash JOIN mb b ON a.hash = b.hash
         WHERE cnt <= {CLIQUE} AND (a.n > b.n OR (a.n = b.n AND a.seq_id < b.seq_id))
       UNION SELECT leader, mb.seq_id, leader_len, n FROM mb JOIN gs ON mb.hash = gs.hash WHERE cnt > {CLIQUE} AND mb.seq_id <> leader)"""


def _f(x: float) -> str:
    import numpy as np

    return f"CAST({float(np.float32(x))!r} AS FLOAT)"


def _cov(mode: int, c: float) -> str:
    a, q, t = "CAST(least(rep_len, member_len) AS FLOAT)", "CAST(greatest(member_len, 1) AS FLOAT)", "CAST(greatest(rep_len, 1) AS FLOAT)"
    return {1: f"{a} / {t} >= {_f(c)}", 2: f"{a} / {q} >= {_f(c)}", 3: f"{t} / {q} >= {_f(c)}"}.get(mode, f"({a} / {q} >= {_f(c)} AND {a} / {t} >= {_f(c)})")


def judged(o: ClusterOptions) -> str:
    """Up to jd(rep, member, rep_len, member_len, mm, reject) of level fast."""
    import numpy as np

    th = o.thresholds
    loss = _f(np.float32(1) - np.float32(th.prefilter_identity))
    ov = "CAST(least(rep_len, member_len) AS FLOAT)"
    allowed = f"greatest(floor({loss} * {ov}), 0)"
    return pairs(o) + f""",
hm AS (SELECT rep, member, rep_len, member_len, CASE WHEN least(rep_len, member_len) = 0 THEN 0 ELSE hamming(left(a.seq, least(rep_len, member_len)), left(b.seq, least(rep_len, member_len))) END AS mm
       FROM pr JOIN s a ON a.seq_id = rep JOIN s b ON b.seq_id = member),
jd AS (SELECT *, CASE WHEN mm > {allowed} THEN 'hamming' WHEN NOT ({_cov(o.cov_mode, th.final_coverage)}) THEN 'ungapped'
         WHEN mm > {allowed} OR CAST(least(rep_len, member_len) - mm AS FLOAT) / {ov} < {_f(th.prefilter_identity)} THEN 'ungapped' END AS reject FROM hm)"""


def clusters(o: ClusterOptions) -> str:
    """Up to cl(cluster_id, rep_id, member_id): the greedy loop over sequences with passing pairs."""
    return judged(o) + """,
ed AS (SELECT rep, member, rep_len FROM jd WHERE reject IS NULL),
nd AS (SELECT seq_id, list(rep) FILTER (rep IS NOT NULL) AS before, row_number() OVER (ORDER BY any_value(n) DESC, seq_id) AS i
       FROM (SELECT DISTINCT unnest([rep, member]) AS id FROM ed) x JOIN l ON l.seq_id = x.id LEFT JOIN ed ON ed.member = l.seq_id GROUP BY seq_id),
lp(i, reps) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT nd.i, CASE WHEN list_has_any(coalesce(before, []), reps) THEN reps ELSE list_append(reps, seq_id) END FROM lp JOIN nd ON nd.i = lp.i + 1),
rp AS (SELECT unnest(reps) AS id FROM (SELECT reps FROM lp ORDER BY i DESC LIMIT 1)),
ow AS (SELECT member, arg_min(rep, (-rep_len, rep)) AS rep FROM ed WHERE rep IN (SELECT id FROM rp) AND member NOT IN (SELECT id FROM rp) GROUP BY member),
pl AS (SELECT l.seq_id, n, coalesce(ow.rep, l.seq_id) AS rep_id FROM l LEFT JOIN ow ON ow.member = l.seq_id),
nm AS (SELECT rep_id, row_number() OVER (ORDER BY n DESC, rep_id) - 1 AS cluster_id FROM pl WHERE seq_id = rep_id),
cl AS (SELECT CAST(cluster_id AS INTEGER) AS cluster_id, pl.rep_id, seq_id AS member_id FROM pl JOIN nm ON pl.rep_id = nm.rep_id)"""


def postings(o: IndexOptions) -> str:
    return seeds(o.k, o.m, False) + f""",
ky AS (SELECT DISTINCT xor(hash, {o.seed}::UBIGINT) AS key, seq_id FROM sd),
ps AS (SELECT key, count(*) AS df, list(seq_id ORDER BY seq_id) AS ids FROM ky GROUP BY key)"""


def gaps(ids: str) -> str:
    """The gaps of a list of ascending ids, the first id included."""
    return f"list_transform(range(1, len({ids}) + 1), lambda i: {ids}[i] - CASE WHEN i = 1 THEN 0 ELSE {ids}[i - 1] END)"


def vbyte_size(g: str) -> str:
    return f"list_sum(list_transform({g}, lambda v: CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END))"


def bp128_size(g: str) -> str:
    block = f"list_slice({g}, 128 * b + 1, least(128 * b + 128, len({g})))"
    bits = f"greatest(length(ltrim(bin(CAST(list_max({block}) AS BIGINT)), '0')), 1)"
    return f"list_sum(list_transform(range(0, (len({g}) + 127) // 128), lambda b: 2 + (len({block}) * {bits} + 31) // 32 * 4))"


#: Documents and pages as two segments, the pages' ids after a trillion.
PAGES_FROM = 10 ** 12
TWO = SEQS.removesuffix(")") + f""" UNION ALL SELECT {PAGES_FROM} + row_number() OVER (ORDER BY page_id) - 1, 'page' || page_id, upper(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '[^A-Za-z]', '', 'g')) FROM pages)"""


def segments(o: IndexOptions) -> str:
    """Up to tn: the statistics of the documents' and the pages' segment."""
    at = "CAST(round(CAST(n_keys - 1 AS FLOAT) * CAST({} AS FLOAT)) AS BIGINT) + 1"
    return seeds(o.k, o.m, False).replace(SEQS, TWO) + f""",
ky AS (SELECT DISTINCT xor(hash, {o.seed}::UBIGINT) AS key, seq_id // {PAGES_FROM} AS seg, seq_id % {PAGES_FROM} AS seq_id FROM sd),
ps AS (SELECT seg, key, count(*) AS df, list(seq_id ORDER BY seq_id) AS ids FROM ky GROUP BY seg, key),
sg AS (SELECT seq_id // {PAGES_FROM} AS seg, count(*) AS n_seqs FROM s GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY df) AS r, count(*) OVER (PARTITION BY seg) AS n_keys FROM ps),
tn AS (SELECT CAST(sg.seg AS INTEGER) AS segment_id, any_value(n_seqs) AS n_seqs, count(key) AS n_keys, coalesce(lower(hex(min(key))), '0') AS min_key, coalesce(lower(hex(max(key))), '0') AS max_key,
  coalesce(max(df) FILTER (r = {at.format(0.5)}), 0) AS df_p50, coalesce(max(df) FILTER (r = {at.format(0.9)}), 0) AS df_p90, coalesce(max(df), 0) AS df_max
  FROM sg LEFT JOIN rk ON rk.seg = sg.seg GROUP BY sg.seg)"""


def counters(o: ClusterOptions) -> str:
    """Up to ev: the pairs that the greedy loop evaluates."""
    return clusters(o) + """,
rs AS (SELECT DISTINCT rep_id FROM cl),
rd AS (SELECT count(*) AS n FROM (SELECT rep AS x FROM pr UNION ALL SELECT member FROM pr) WHERE x IN (SELECT rep_id FROM rs)),
ev AS (SELECT jd.* FROM jd JOIN cl ON cl.member_id = jd.member JOIN l ON l.seq_id = cl.rep_id
       WHERE jd.rep IN (SELECT rep_id FROM rs) AND (l.n < jd.rep_len OR (l.n = jd.rep_len AND cl.rep_id >= jd.rep)))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"
