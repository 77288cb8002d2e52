"""Shared parts of the operators: table loading, scratch storage, vectorised word hashing.

Texts are handled in whole.  A null text counts as an empty text everywhere.
"""
from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import file_system as open_fs
from ..storage import scratch_dir

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that Spark hands a Python worker at a time (a longer single row goes whole).
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches bounded in bytes from now on in its session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: By name, what a worker keeps from one task to the next.
KEPT: dict[str, dict] = {}


def tidy(own: str) -> None:
    """Drop what others than ``own`` keep, and give freed memory back to the system.

    A worker stays for later stages, and shares its executor's memory with all other workers.
    """
    for name, kept in KEPT.items():
        if name != own:
            kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library that has no such call


def lean(run, own: str = ""):
    """``run`` (a function of ``mapInArrow``) in a worker that holds no freed memory before and after."""

    def work(batches):
        tidy(own)
        try:
            yield from run(batches)
        finally:
            tidy(own)

    return work


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again.

    Cuts the lineage: a lost executor costs a reread of files, not of the work that made them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(path: str, data: bytes) -> None:
    """Write a file under a temporary name, then rename it: a retried task leaves a whole file."""
    fs, where = open_fs(path)
    fs.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, where)


# --------------------------------------------------------------------------- hashing

def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on whole arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalnum():
        _FOLD[_b] = ord(_c.lower()) if _b < 128 else _b
_POS = 64
_TAB = seeded(_POS * 256, 77)


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("").cast(pa.large_string())
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    if data is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0]: o[-1]], o - o[0]


def unspaced(data: np.ndarray):
    """Characters of scripts written without spaces: (place, length) of each, and of their punctuation.

    Han, kana, Thai, Lao, Burmese and Khmer, by the first bytes of their characters.
    """
    after = np.append(data[1:], np.uint8(0))
    mark = (data == 0xE3) & (after == 0x80)  # U+3000 to U+303F
    three = ((data >= 0xE3) & (data <= 0xE9) & ~mark) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F)))
    four = (data == 0xF0) & (after >= 0xA0) & (after < 0xB4)
    own = np.flatnonzero(three | four)
    return own, np.where(four[own], 4, 3), np.flatnonzero(mark)


def word_hashes(data: np.ndarray, offs: np.ndarray, characters: bool = False):
    """Words of many texts at once.

    A word is a maximal run of ASCII letters and digits and of non-ASCII bytes; ASCII letters
    are folded to lower case.  With ``characters`` each character of a script without spaces is a
    word.  Returns (hash, start, end, first): a 64-bit hash and the byte
    range of every word, and for each text the index of its first word (one more at the end).
    """
    norm = _FOLD[data]
    w = norm != 0
    n = len(w)
    if characters:
        own, length, marks = unspaced(data)
        for k in range(3):
            w[marks + k] = False
    if not w.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    if characters and len(own):
        stop = own + length
        start[own] = last[stop - 1] = True
        start[stop[stop < n]] |= w[stop[stop < n]]
        last[own[own > 0] - 1] |= w[own[own > 0] - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(last) + 1
    ln = e - s
    at = np.zeros(len(s), np.int64)
    np.cumsum(ln[:-1], out=at[1:])
    flat = norm[w].astype(np.int32)
    pos = np.arange(len(flat), dtype=np.int32) - np.repeat(at.astype(np.int32), ln)
    val = _TAB[((pos & (_POS - 1)) << 8) + flat]
    if ln.max() > _POS:
        val = val * ((pos >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = mix(np.add.reduceat(val, at) + ln.astype(np.uint64))
    return h, s, e, np.searchsorted(s, offs)


def text_chunks(arr: pa.Array, limit: int = 2_000_000):
    """(row from, row to, bytes, offsets) pieces of about ``limit`` bytes; no text is cut."""
    data, offs = text_buffers(arr)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


SHINGLE = 5
_MULT = (seeded(SHINGLE, 5) | np.uint64(1))


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE):
    """Word shingles of many texts: (hash, offsets).

    A text of 1 to k - 1 words has one shingle, all its words; a text without words has none.
    """
    cnt = np.diff(first)
    n = np.where(cnt >= k, cnt - k + 1, np.minimum(cnt, 1))
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    if not len(h):
        return np.zeros(0, np.uint64), offs
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j: j + len(full)] * _MULT[j]
    out = np.zeros(offs[-1], np.uint64)
    big = cnt >= k
    idx = np.arange(offs[-1]) - np.repeat(offs[:-1] - first[:-1], n)
    row_big = np.repeat(big, n)
    out[row_big] = mix(full[idx[row_big]])
    for r in np.flatnonzero(~big & (cnt > 0)):
        a = np.array([cnt[r]], np.uint64)
        for x in h[first[r]: first[r + 1]]:
            a = mix(a ^ x) * _MULT[0]
        out[offs[r]] = mix(a)[0]
    return out, offs
