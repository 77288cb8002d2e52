"""Arrow functions over whole batches, and their names in SQL."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def pieces(arr: pa.Array, limit: int = 1_000_000):
    """Slices of a string column of about ``limit`` bytes, whole values each."""
    data, offs = buffers(arr)
    i = 0
    while i < len(arr):
        j = min(max(int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1, i + 1), len(arr))
        yield i, j, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


SEEDS = "seq_id long, hash long, pos int"
MEMBERS = SEEDS + ", seq_len int, again boolean"


def seed_rows(df: DataFrame, k: int, m: int, reduce: bool) -> DataFrame:
    """``df`` (seq_id, seq), ids being unique, to its bottom-m seeds, a row each (hash: the unsigned value's bits).

    ``again``: the sequence has the same hash at an earlier place too, so the rows without it are the
    distinct (hash, seq_id), and nothing has to be shuffled to find them.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in pieces(batch.column(1)):
                h, p, o = K.seeds(data, offs, k, m, reduce)
                again = np.zeros(len(h), bool)
                again[1:] = h[1:] == h[:-1]
                again[o[:-1][o[:-1] < len(h)]] = False
                cols = [pa.array(np.repeat(x, np.diff(o)).astype(t)) for x, t in ((ids[i:j], np.int64), (np.diff(offs), np.int32))]
                yield pa.RecordBatch.from_arrays([cols[0], pa.array(h.view(np.int64)), pa.array(p.astype(np.int32)), cols[1], pa.array(again)], ["seq_id", "hash", "pos", "seq_len", "again"])

    return df.select("seq_id", "seq").mapInArrow(run, MEMBERS)


def variable_seed_rows(df: DataFrame, m: int) -> DataFrame:
    """``df`` (seq_id, seq, k) to exact seeds with a k of each row's own."""

    def run(batches):
        for batch in batches:
            ids, ks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for k in np.unique(ks):
                own = np.flatnonzero(ks == k)
                sub = batch.column(1).take(pa.array(own))
                for i, j, data, offs in pieces(sub):
                    h, p, o = K.seeds(data, offs, int(k), m, False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own[i:j]], np.diff(o)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(p.astype(np.int32))], ["seq_id", "hash", "pos"])

    return df.select("seq_id", "seq", "k").mapInArrow(run, SEEDS)


def sketch_rows(df: DataFrame) -> DataFrame:
    """``df`` (seq_id, seq) to (seq_id, sketch)."""

    def run(batches):
        for batch in batches:
            for i, j, data, offs in pieces(batch.column(1)):
                words, at = K.sketches(data, offs)
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed.cast(pa.binary())], ["seq_id", "sketch"])

    return df.select("seq_id", "seq").mapInArrow(run, "seq_id long, sketch binary")


#: Pairs of a cell that are looked at together.
PAIRS = 1 << 15
PARTNERS = ["rep", "member", "rep_len", "member_len", "more"]


def _partners(rows: pa.Table, identity: float, coverage: float, mode: int, few: int) -> pa.RecordBatch:
    """Partners within whole cells, the rows of a cell being together."""
    key, i, j, block, ids, text, size, fixed = (rows.column(c).to_numpy() for c in range(8))
    sketch = rows.column(8).combine_chunks().cast(pa.large_binary())
    at = np.frombuffer(sketch.buffers()[1], np.int64)[sketch.offset: sketch.offset + len(sketch) + 1] // 8
    words = np.frombuffer(sketch.buffers()[2], np.uint64)
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
    order = np.lexsort((ids, -size.astype(np.int64), group))
    group, block, ids, text, size, fixed, at = group[order], block[order], ids[order], text[order], size[order].astype(np.int64), fixed[order], at[:-1][order]
    across = (i != j)[order]
    # Later sequences are shorter, so those that can be covered come first.
    shortest = np.floor(size * (coverage * (1 - 1e-6))).astype(np.int64) if mode not in (2, 3) else np.zeros(len(size), np.int64)
    rank, top = (group << 32) - size, np.arange(len(size))
    later = np.searchsorted(rank, (group << 32) - shortest, side="right") - top - 1
    allowed = np.maximum(np.floor((np.float32(1) - np.float32(identity)) * size.astype(np.float32)), 0) + 1
    found, more, out = np.zeros(len(size), np.int64), np.zeros(len(size), bool), []
    for part in np.split(top, np.searchsorted(np.cumsum(later), np.arange(PAIRS, int(later.sum()), PAIRS))):
        a = np.repeat(part, later[part])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
        look = ~fixed[b] & (fixed[a] | ~more[b]) & (text[a] != text[b]) & ~(across[a] & (block[a] == block[b]))
        a, b = a[look], b[look]
        near = K.least_mismatches(words, at, size, a, b) <= allowed[b]
        a, b = a[near], b[near]
        free = np.flatnonzero(~fixed[a])
        free = free[np.argsort(b[free], kind="stable")]
        own = b[free]
        nth = found[own] + np.arange(len(own)) - np.searchsorted(own, own)
        np.add.at(found, own, 1)
        more[own[nth >= few]] = True
        keep = np.ones(len(a), bool)
        keep[free[nth >= few]] = False
        out.append((a[keep], b[keep]))
    a, b = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(size[a].astype(np.int32)), pa.array(size[b].astype(np.int32)), pa.array(more[b])], PARTNERS)


def partner_rows(cells: DataFrame, identity: float, coverage: float, mode: int, few: int) -> DataFrame:
    """``cells`` (hash, i, j, block, seq_id, text, seq_len, fixed, sketch), a cell's rows together, to pairs that may pass the screen.

    (rep, member, rep_len, member_len, more).  A member that isn't ``fixed`` gets every fixed partner before it and the first
    ``few`` others; ``more`` says that it has others beyond them.  In a cell of two blocks only pairs across them count.
    """

    def run(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(c)[len(batch) - 1].as_py() for c in range(3)]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == last[c] for c in range(3)])
            start = int(same.argmax())  # of the last cell, which may go on
            if start or (held and [held[-1].column(c)[0].as_py() for c in range(3)] != last):
                done = pa.Table.from_batches([*held, batch.slice(0, start)])
                held = []
                yield _partners(done, identity, coverage, mode, few)
            held.append(batch.slice(start))
        if held:
            yield _partners(pa.Table.from_batches(held), identity, coverage, mode, few)

    return cells.select("hash", "i", "j", "block", "seq_id", "text", "seq_len", "fixed", "sketch").mapInArrow(run, "rep long, member long, rep_len int, member_len int, more boolean")


@F.arrow_udf(T.LongType())
def fnv1a64(seq: pa.Array) -> pa.Array:
    data, offs = buffers(seq)
    return pa.array(K.fnv1a64(data, offs).view(np.int64))


def _each(a: pa.Array, b: pa.Array):
    for x, y in zip(a.cast(pa.large_binary()).to_pylist(), b.cast(pa.large_binary()).to_pylist()):
        yield x or b"", y or b""


@F.arrow_udf(T.IntegerType())
def hamming_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Mismatches over the shorter length."""
    return pa.array(K.mismatches_many(*buffers(a), *buffers(b)))


ALIGNED = T.StructType([T.StructField(n, T.IntegerType()) for n in ("score", "aligned_len", "matches")])


def _aligned(rows) -> pa.Array:
    cols = list(zip(*rows)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], ["score", "aligned_len", "matches"])


def aligner(scoring: K.Scoring):
    """Full local alignment of two columns, as the search does it."""

    @F.arrow_udf(ALIGNED)
    def sw_align(a: pa.Array, b: pa.Array) -> pa.Array:
        return _aligned(K.align_full_many(list(_each(a, b)), scoring))

    return sw_align


def banded_aligner(scoring: K.Scoring, min_identity: float):
    """The clustering's alignment: size limit, score floor, band, traceback."""

    @F.arrow_udf(ALIGNED)
    def sw_align_banded(a: pa.Array, b: pa.Array) -> pa.Array:
        return _aligned(K.align_pairs(list(_each(a, b)), scoring, min_identity))

    return sw_align_banded


def _with_alignment(df: DataFrame, a: str, b: str, align) -> DataFrame:
    """``df`` with score, aligned_len and matches in place of the sequences ``a`` and ``b``.

    A step of its own for Catalyst, which would else align in one go with the mismatch counts, before the
    filters between them.
    """
    keep = [c for c in df.columns if c not in (a, b)]

    def run(batches):
        for batch in batches:
            found = _aligned(align(list(_each(batch.column(len(keep)), batch.column(len(keep) + 1)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found.flatten()], [*keep, *ALIGNED.names])

    return df.select(*keep, a, b).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *ALIGNED.fields]))


def with_alignment(df: DataFrame, a: str, b: str, scoring: K.Scoring) -> DataFrame:
    """Rows with the search's alignment of two columns."""
    return _with_alignment(df, a, b, lambda pairs: K.align_full_many(pairs, scoring))


def with_banded_alignment(df: DataFrame, a: str, b: str, scoring: K.Scoring, min_identity: float) -> DataFrame:
    """Rows with the clustering's alignment of two columns."""
    return _with_alignment(df, a, b, lambda pairs: K.align_pairs(pairs, scoring, min_identity))


def decoded(postings: DataFrame) -> DataFrame:
    """``postings`` (segment_id, key, df, tier, codec, encoded) with ``seq_ids`` in place of the last two.

    A step of its own for Catalyst, which so can't decode lists a second time to look into them.
    """

    def run(batches):
        for batch in batches:
            names, packed = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ids = [K.ungaps(K.CODECS[n][1](x)) for n, x in zip(names, packed)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int64()))], ["segment_id", "key", "df", "tier", "seq_ids"])

    return postings.select("segment_id", "key", "df", "tier", "codec", "encoded").mapInArrow(run, "segment_id int, key long, df long, tier string, seq_ids array<long>")


def codec(name: str, encode: bool):
    """A posting codec over arrays of ids (gaps included)."""
    pack, unpack = K.CODECS[name]
    if encode:
        return F.arrow_udf(lambda v: pa.array([pack(K.gaps(x)) for x in v.to_pylist()], pa.binary()), T.BinaryType())
    return F.arrow_udf(lambda v: pa.array([K.ungaps(unpack(x)) for x in v.to_pylist()], pa.list_(pa.int64())), T.ArrayType(T.LongType()))


def register(spark) -> None:
    """kmer functions and alignments for SQL."""
    spark.udf.register("fnv1a64", fnv1a64)
    spark.udf.register("hamming_overlap", hamming_overlap)
    spark.udf.register("sw_align", aligner(K.PROTEIN))
    spark.udf.register("sw_align_banded", banded_aligner(K.PROTEIN, 0.9))
    kind = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.IntegerType())]))

    @F.arrow_udf(kind)
    def kmer_seeds(seq: pa.Array, k: pa.Array, m: pa.Array, reduce: pa.Array) -> pa.Array:
        out = []
        for s, kk, mm, r in zip(seq.to_pylist(), k.to_pylist(), m.to_pylist(), reduce.to_pylist()):
            raw = np.frombuffer((s or "").encode(), np.uint8)
            h, p, _ = K.seeds(raw, np.array([0, len(raw)]), kk, mm, r)
            out.append([{"hash": int(x), "pos": int(y)} for x, y in zip(h.view(np.int64), p)])
        return pa.array(out, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))

    spark.udf.register("kmer_seeds", kmer_seeds)
