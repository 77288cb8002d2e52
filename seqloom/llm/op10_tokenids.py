"""Token-id files: frequency-ranked ids, byte-aligned codes, separate control bytes.

A shard holds documents in ascending order of id.  Its ids are replaced by their rank of
frequency in the shard (the table is part of the file), so the commonest 256 take one byte, the
next 65,280 two, and so on up to four.  Two bits in a control byte give the length of each of
four codes; control and data bytes lie apart, so a reader finds all lengths by one numpy table
lookup over the control bytes and all codes by a gather.  Each document starts at a control
byte of its own (up to three codes of padding), so it can be read alone.

File, little-endian: magic, u64 documents, u64 ids, u64 control bytes, u64 data bytes, u32 size
of the rank table; then u32 ids by rank, i64 document ids, u64 document lengths, u64 data
offsets of the documents, control bytes, data bytes.

The texts are encoded where they are read; only ids travel, in one shuffle to ranges of the
document id.  The library encodes each distinct word of plain texts once and a cache of
bounded size keeps the result, where its own pattern would cut the text in these words; other
texts go through it in whole.  The ids are those of an encoding of the whole text.

Defined results: a null or empty text holds the end id alone; documents without an id come
first; documents that share an id are ordered by their ids' checksum; extra columns are ignored.
The pipeline stage keeps the order of its input instead of that of the ids.
"""
from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, lean, mix, open_fs, scratch_dir, seeded, small_batches, stored, table, text_chunks, write_once

END_ID = 2
#: Ids of a shard file, from which on a new one begins at the next document.
SHARD_IDS = 2_000_000
#: Documents of a range of ids, and the most ranges.
RANGE_DOCS, MAX_RANGES = 2_000, 65_536
#: Pieces that a worker keeps before it starts anew.
CACHE = 1_500_000
MAGIC = b"RVBSHRD1"
_HEAD = struct.Struct("<8sQQQQI")

# ------------------------------------------------------------------ codes

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray, lengths: np.ndarray):
    """(ids by rank, control, data, data offsets) of documents that lie end to end in ``ids``."""
    ids = ids.astype(np.int64)
    top = int(ids.max()) + 1 if len(ids) else 0
    count = np.bincount(ids, minlength=top)
    order = np.lexsort((np.arange(top), -count))[: int((count > 0).sum())]
    rank = np.zeros(top, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    padded = (lengths + 3) // 4 * 4
    where = np.arange(len(ids)) + np.repeat(np.cumsum(padded - lengths) - (padded - lengths), lengths)
    full = np.zeros(int(padded.sum()), np.uint32)
    full[where] = rank[ids]
    size = 1 + (full >= 1 << 8).astype(np.uint8) + (full >= 1 << 16) + (full >= 1 << 24)
    quad = (size - 1).reshape(-1, 4)
    control = (quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = np.zeros(ends[-1], np.uint8)
    data[ends[:-1]] = full  # the low byte
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[ends[more] + k] = full[more] >> np.uint32(8 * k)
    starts = ends[np.concatenate([[0], np.cumsum(padded)[:-1]]).astype(np.int64)] if len(lengths) else np.zeros(0, np.int64)
    return order.astype("<u4"), control, data, starts.astype("<u8")


def unpack(control: np.ndarray, data: np.ndarray, by_rank: np.ndarray) -> np.ndarray:
    """All ids of a run of whole documents, padding included."""
    size = _LENGTHS[control].ravel()
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return by_rank[out] if len(by_rank) else out


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    by_rank, control, data, starts = pack(ids, lengths)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(control), len(data), len(by_rank))
    return b"".join([head, by_rank.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), control.tobytes(), data.tobytes()])


class Shard:
    """A shard file in memory: ``doc_ids``, ``lengths``, ``ids()`` and ``document(k)``."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_ids, n_control, n_data, n_rank = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEAD.size

        def take(kind: str, n: int):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.by_rank, self.doc_ids = take("<u4", n_rank), take("<i8", docs)
        self.lengths, self.starts = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.control, self.data = take("u1", n_control), take("u1", n_data)
        self.control_at = np.concatenate([[0], np.cumsum((self.lengths + 3) // 4)])

    def ids(self) -> np.ndarray:
        """All ids, documents end to end."""
        full = unpack(self.control, self.data, self.by_rank)
        real = np.ones(len(full), bool)
        stop = self.control_at[1:] * 4
        for k in (1, 2, 3):
            pad = stop - self.control_at[:-1] * 4 - self.lengths >= k
            real[stop[pad] - k] = False
        return full[real]

    def document(self, k: int) -> np.ndarray:
        a, b = self.control_at[k], self.control_at[k + 1]
        return unpack(self.control[a:b], self.data[self.starts[k]:], self.by_rank)[: self.lengths[k]]


# ------------------------------------------------------------------ encoding

# Classes of bytes: letters, digits, marks, space, line feed; the rest isn't plain.
_LETTER, _DIGIT, _MARK, _SPACE, _FEED, _REST = range(6)
_CLASS = np.full(256, _REST, np.uint8)
for _b in range(33, 127):
    _c = chr(_b)
    _CLASS[_b] = _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _MARK
_CLASS[0xC3:0xCA] = _LETTER  # first bytes of U+00C0 to U+027F; two of these are no letters, see below
_CLASS[0x80:0xC0] = _LETTER  # their second bytes
_CLASS[32], _CLASS[10], _CLASS[39] = _SPACE, _FEED, _REST
_HASH = seeded(64 * 256, 4242)
_ODD = seeded(64, 4243) | np.uint64(1)


def plain_pieces(data: np.ndarray, offs: np.ndarray, special: tuple[bytes, ...] = ()):
    """Pieces of many texts, where classes of bytes tell them: (plain, hash, start, end, text).

    The library's pattern takes a run of letters, digits or marks, with one space before it, as
    a piece, and a line feed between other characters as another.  ``plain`` says for each text
    whether it has nothing else (apostrophes, other white space or white space side by side,
    characters beyond U+027F, special strings); the arrays hold the pieces of the plain texts only.
    """
    n = len(offs) - 1
    cls = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    first = first[:-1]
    prev = np.concatenate([[_REST], cls[:-1]]).astype(np.uint8) if len(data) else cls
    white, white_before = (cls == _SPACE) | (cls == _FEED), ((prev == _SPACE) | (prev == _FEED)) & ~first
    bad = (cls == _REST) | (white & white_before)
    lead = np.concatenate([[0], data[:-1]]) if len(data) else data
    bad |= (lead == 0xC3) & ((data == 0x97) | (data == 0xB7))  # the signs of multiplication and division
    tail = (data >= 0x80) & (data < 0xC0)
    bad |= tail & ~((lead >= 0xC3) & (lead < 0xCA))  # a byte of a longer character
    plain = np.diff(offs) > 0
    where = np.flatnonzero(bad)
    plain[np.searchsorted(offs, where, side="right") - 1] = False
    raw = data.tobytes() if special else b""
    for mark in special:
        at = raw.find(mark)
        while at >= 0:
            plain[np.searchsorted(offs, at, side="right") - 1] = False
            at = raw.find(mark, at + 1)
    ends = offs[1:][plain] - 1
    plain[np.flatnonzero(plain)[cls[ends] == _SPACE]] = False
    start = first | white | ((cls != prev) & (prev != _SPACE))
    keep = np.repeat(plain, np.diff(offs))
    s = np.flatnonzero(start & keep)
    if not len(s):
        return plain, np.zeros(0, np.uint64), np.zeros(0, np.uint64), s, s, s
    flat = data[keep].astype(np.int32)
    text = np.searchsorted(offs, s, side="right") - 1
    size = np.diff(offs) * plain
    into = np.cumsum(size) - size  # where each text begins among the kept bytes
    at = s - offs[text] + into[text]
    length = np.diff(np.append(at, len(flat)))
    pos = np.arange(len(flat), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    val = _HASH[((pos & 63) << 8) + flat]
    if length.max() > 64:
        val = val * ((pos >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = mix(np.add.reduceat(val, at) + length.astype(np.uint64))
    g = mix(np.add.reduceat(val * _ODD[pos & 63], at) + length.astype(np.uint64))
    return plain, h, g, s, s + length, text


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of two or four bytes.

    The pieces of plain texts are encoded once each and kept by a 64-bit hash, which a second one has to
    confirm; texts with a piece whose hashes don't agree, and all other texts, are encoded in whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kind = "<u2" if max(self.lib.get_vocab().values()) < 1 << 16 else "<u4"
        self.limit = cache
        self.special = tuple(t.content.encode() for t in self.lib.get_added_tokens_decoder().values() if t.content)
        feed = self.lib.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and for each the second one and its place in ``flat``
        self.check = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 if unknown, -2 if they are another piece's: a direct table first, then a search for the rest."""
        out = np.full(len(h), -1, np.int64)
        if len(self.known):
            row = self.direct[(h >> np.uint64(64 - _DIRECT)).astype(np.int64)]
            hit = self.known[row] == h
            out[hit] = row[hit]
            rest = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(self.known, h[rest]), len(self.known) - 1)
            same = self.known[at] == h[rest]
            out[rest[same]] = at[same]
            out[(out >= 0) & (self.check[out] != g)] = -2
        return out

    def _learn(self, h: np.ndarray, g: np.ndarray, words: list[str]) -> None:
        ids = np.array(self.lib.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, self.kind)
        feeds = np.flatnonzero(ids == self.feed)
        start, stop = np.append(0, feeds + 1), np.append(feeds, len(ids))
        if len(start) != len(words):
            raise ValueError("the vocabulary does not cut words as expected")
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.check = np.insert(self.check, at, g)
        self.begin = np.insert(self.begin, at, start + len(self.flat))
        self.size = np.insert(self.size, at, stop - start)
        self.flat = np.concatenate([self.flat, ids])
        self.direct = np.zeros(1 << _DIRECT, np.int32)
        self.direct[(self.known >> np.uint64(64 - _DIRECT)).astype(np.int64)] = np.arange(len(self.known), dtype=np.int32)

    def encode(self, arr: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text, with the end id."""
        out: list = [None] * len(arr)
        end = np.array([end_id], self.kind).tobytes()
        for i, j, data, offs in text_chunks(arr, 2_000_000):
            if self.feed is None:
                break
            plain, h, g, s, e, text = plain_pieces(data, offs, self.special)
            if not len(h):
                continue
            if len(self.known) > self.limit:
                self._forget()
            feeds = (e - s == 1) & (data[s] == 10)
            h[feeds] = g[feeds] = _FEED_HASH
            row = self._find(h, g)
            new = np.flatnonzero(row == -1)
            if len(new):
                uniq, at = np.unique(h[new], return_index=True)
                raw, at = data.tobytes(), new[at]
                words = [raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist())]
                if uniq[0] == _FEED_HASH:  # the line feed separates words in _learn
                    self.known, self.check = np.insert(self.known, 0, _FEED_HASH), np.insert(self.check, 0, _FEED_HASH)
                    self.begin, self.size = np.insert(self.begin, 0, len(self.flat)), np.insert(self.size, 0, 1)
                    self.flat = np.append(self.flat, np.array([self.feed], self.kind))
                    self.direct = np.zeros(1 << _DIRECT, np.int32)
                    uniq, at, words = uniq[1:], at[1:], words[1:]
                if len(words):
                    self._learn(uniq, g[at], words)
                row = self._find(h, g)
            if (row < 0).any():
                plain[text[row < 0]] = False
                whole = plain[text]
                row, text = row[whole], text[whole]
            size = self.size[row]
            src = np.repeat(self.begin[row] - (np.cumsum(size) - size), size)
            src += np.arange(len(src))
            raw = self.flat[src].tobytes()
            width = self.flat.itemsize
            total = np.bincount(text, size, j - i).astype(np.int64)
            stop = np.cumsum(total) * width
            for k, a, b in zip(np.flatnonzero(plain).tolist(), (stop - total * width)[plain].tolist(), stop[plain].tolist()):
                out[i + k] = raw[a:b] + end
        whole = [i for i, x in enumerate(out) if x is None]
        texts = arr.take(pa.array(whole, pa.int64())).to_pylist() if whole else []
        for i, x in zip(whole, self.lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False) if whole else ()):
            out[i] = np.array([*x.ids, end_id], self.kind).tobytes()
        return out


_DIRECT = 21
_FEED_HASH = np.uint64(0)
_encoders: dict[str, Encoder] = KEPT.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ write and read

FILES = "range int, seq int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, out_dir: str) -> DataFrame:
    """Encode ``docs`` (id, at, text), in the order of ``at``, into shard files below ``out_dir``; returns FILES rows."""
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_DOCS)))
    marks = docs.approxQuantile("at", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    marks = np.unique(np.array(marks, np.float64))
    wide = encoder(tokenizer).kind == "<u4"

    def encoded(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = part.column(0)
                at_ = part.column(1).fill_null(-(2 ** 63))
                where = np.searchsorted(marks, at_.to_numpy().astype(np.float64), side="right")
                codes = enc.encode(part.column(2), end_id)
                crc = pa.array([zlib.crc32(c) for c in codes], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), at_, ids, crc, pa.array(codes, pa.binary())], ["range", "at", "id", "crc", "ids"])

    kind = "<u4" if wide else "<u2"

    def write(batches):
        names, codes, size, seq, now = [], [], 0, 0, None
        found = []

        def flush():
            nonlocal names, codes, size, seq
            if names:
                lengths = np.array([len(c) for c in codes], np.int64) // np.dtype(kind).itemsize
                raw = shard_bytes(np.array(names, np.int64), lengths, np.frombuffer(b"".join(codes), kind))
                path = f"{out_dir}/{now:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"  # no other attempt's name
                write_once(path, raw)
                found.append((now, seq, path, len(names), int(lengths.sum())))
                seq += 1
            names, codes, size = [], [], 0

        for batch in batches:
            for r, i, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if r != now:
                    flush()
                    now, seq = r, 0
                names.append(-(2 ** 63) if i is None else i)
                codes.append(c)
                size += len(c)
                if size >= SHARD_IDS * np.dtype(kind).itemsize:
                    flush()
        flush()
        cols = list(zip(*found)) if found else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["range", "seq", "path", "n_docs", "n_ids"])

    rows = small_batches(docs).mapInArrow(lean(encoded, "encoders"), "range int, at long, id long, crc long, ids binary")
    rows = rows.repartition(max(1, ranges), "range").sortWithinPartitions("range", "at", "id", "crc")
    return stored(rows.mapInArrow(lean(write, "encoders"), FILES), "shard-list")


def read_ids(files: DataFrame) -> DataFrame:
    """Shard files back to (id, start, n_tokens, ids_crc32)."""
    sums = files.groupBy("range").agg(F.sum("n_ids").alias("total"))  # at most MAX_RANGES rows
    before = sums.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("range").orderBy("seq")) - F.col("n_ids")
    placed = files.withColumn("inner", inner).join(before, "range").select("path", (F.col("before") + F.col("inner")).alias("base"))
    placed = stored(placed, "shard-bases")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = open_fs(path)
                with fs.open_input_stream(where, compression=None) as f:
                    shard = Shard(f.read())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                none = shard.doc_ids == -(2 ** 63)
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=none), pa.array(starts + base), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(4096, placed.count()))
    return placed.repartition(n, "path").mapInArrow(lean(read, "encoders"), "id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, at="doc_id") -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards, in the order of ``at``, in the shared scratch folder and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    at = F.col(at) if isinstance(at, str) else at
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), at.cast("long").alias("at"), F.col("text").cast("string").alias("text"))
    files = write_ids(texts, tokenizer, end_id, scratch_dir(docs.sparkSession, "token-ids"))
    return read_ids(files).withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))


def position(docs: DataFrame):
    """A number in whose order the rows stand in their files; files come in the order of their names.

    Spark's part files go by their numbers.  Rows that come from no file stand as they are.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part, piece = (F.regexp_extract("_metadata.file_name", r"part-(\d+).*?(?:-c(\d+)\.|$)", k) for k in (1, 2))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    return F.shiftleft(number(part), 44) + F.shiftleft(number(piece), 36) + F.col("_metadata.row_index")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the kept documents as token-id shards in the order of their files' rows, read back."""
    return encode_and_read(docs, at=position(docs))
