"""WARC archives from pages, and the normaliser of monolithic gzip files.

``write_archives`` writes WARC/1.1 files as one gzip stream each, the way some crawlers do: such
a file can't be entered at a record.  ``normalise`` inflates each of these streams once, front to
back, writes every record as a gzip member of its own and beside it an index of byte offsets.
``read_archives`` goes through the index and opens one member at a time.

Pages of equal payloads (same SHA-1 and length, at least MIN_REVISIT bytes): that of the largest
page_id is the response, the others are revisits that name it.  A revisit has the HTTP header of
its page, with the payload's length, and no payload.

Files lie in the scratch folder that all executors share, under names that no other attempt of a
task uses; a file counts only once its task's row is committed.  Archives are rolled over at
FILE_BYTES, so a task holds one record and some buffers.

Defined results: null html is an empty payload; a null url has no target header; a null page_id
is always a response; rows that repeat page_id and payload are all responses or all revisits;
extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, scratch_dir, small_batches, stored, table

MIN_REVISIT = 0
FILE_BYTES = 32_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


class Stream:
    """Bytes of a gzip file of any number of members, inflated as they are asked for."""

    def __init__(self, f):
        self.f, self.z, self.buf, self.end = f, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        if self.end:
            return False
        raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.f.read(_CHUNK)
        if self.z.eof:
            if not raw:
                self.end = True
                return False
            self.z = zlib.decompressobj(31)
        out = self.z.decompress(raw, _CHUNK)
        if not raw and not out and not self.z.eof:
            raise EOFError("the gzip stream ends early")
        self.buf += out
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        seen = 0
        while (i := self.buf.find(mark, seen)) < 0:
            seen = max(0, len(self.buf) - len(mark) + 1)
            if not self._more():
                if self.buf:
                    raise EOFError("the record's header ends early")
                return None
        out = bytes(self.buf[: i + len(mark)])
        del self.buf[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise EOFError("the record's block ends early")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream: Stream):
    """(fields, whole record) of a stream, one after the other."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        at = fields(head)
        block = stream.take(int(at["content-length"]) + 4)
        if block[-4:] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield at, head + block


class Output:
    """A file under a temporary name that is renamed when it is whole."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.where = open_fs(path)
        self.fs.create_dir(os.path.dirname(self.where), recursive=True)
        self.f = self.fs.open_output_stream(self.where + ".tmp", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.f.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.f.close()
        self.fs.move(self.where + ".tmp", self.where)


RAW = "path string, n_records long"
NORMAL = "path string, index_path string, n_records long"


def write_archives(pages: DataFrame, out_dir: str) -> DataFrame:
    """``pages`` (page_id, url, html, refers_to) to monolithic archives; returns RAW rows."""

    def run(batches):
        out, z, n, size, done = None, None, 0, 0, []

        def close():
            nonlocal out, n, size
            if out is not None:
                out.write(z.flush())
                out.close()
                done.append((out.path, n))
            out, n, size = None, 0, 0

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, z = Output(f"{out_dir}/{uuid.uuid4().hex}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31)
                rec = record(page_id, url, (html or "").encode(), refers)
                out.write(z.compress(rec))
                n += 1
                size += len(rec)
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "n_records"])

    return stored(small_batches(pages).mapInArrow(run, RAW), "raw-archives")


def _each_file(files: DataFrame) -> DataFrame:
    n = max(1, min(20_000, files.count()))
    return files.repartition(n, "path")


def normalise(files: DataFrame, out_dir: str) -> DataFrame:
    """Rewrite archives (RAW rows) with a member for each record and a sidecar index; NORMAL rows.

    The index has a line for each record: offset, length, type, page id, digest.
    """

    def run(batches):
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                fs, where = open_fs(path)
                name = f"{out_dir}/{uuid.uuid4().hex}.warc.gz"
                out, lines = Output(name), Output(name + ".idx")
                n = 0
                with fs.open_input_stream(where, compression=None) as f:
                    for at, rec in records(Stream(f)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        lines.write(f"{out.size}\t{len(member)}\t{at['warc-type']}\t{at.get('x-page-id', '')}\t{at['warc-payload-digest']}\n".encode())
                        out.write(member)
                        n += 1
                out.close()
                lines.close()
                done.append((name, name + ".idx", n))
            cols = list(zip(*done)) if done else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["path", "index_path", "n_records"])

    return stored(_each_file(files.select("path")).mapInArrow(run, NORMAL), "archives")


def read_record(member: bytes) -> dict:
    """Fields of a record from its gzip member; the payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    at = fields(head)
    block = rest[: int(at["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(fields(http)["content-length"])
    sha = at["warc-payload-digest"].removeprefix("sha1:")
    if at["warc-type"] == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"the payload of record {at['warc-record-id']} is not what its header says")
    refers = at.get("x-refers-to-page")
    return {
        "page_id": int(at["x-page-id"]) if "x-page-id" in at else None, "payload_bytes": length, "payload_digest": sha, "record_type": at["warc-type"],
        "refers_to": None if refers is None else int(refers), "url": at.get("warc-target-uri"), "payload": payload,
    }


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def read_archives(files: DataFrame) -> DataFrame:
    """Read normalised archives (NORMAL rows) member by member through their indexes; ROWS."""

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = open_fs(path)
                ifs, iwhere = open_fs(index)
                with ifs.open_input_stream(iwhere, compression=None) as f:
                    entries = [x.split("\t") for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(where) as f:
                    for offset, length, *_ in entries:
                        f.seek(int(offset))
                        got = read_record(f.read(int(length)))
                        rows.append([got[k] for k in _NAMES])
                cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)

    return _each_file(files.select("path", "index_path")).mapInArrow(run, ROWS)


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the response's page_id for a revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    ids = keyed.select("page_id", "sha", "size").filter(F.col("page_id").isNotNull() & (F.col("size") >= least))
    first = ids.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to")
    seen = ids.join(first, ["sha", "size"]).filter("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    return keyed.join(seen, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    raw = write_archives(with_revisits(pages), scratch_dir(spark, "warc-raw"))
    return read_archives(normalise(raw, scratch_dir(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT sha, n, max(page_id) AS top FROM p GROUP BY sha, n),
b AS (SELECT sha, n, top, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits FROM m),
d AS (SELECT sha, n, top, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(power(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS b32 FROM b)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN d ON p.sha = d.sha AND p.n = d.n
"""
