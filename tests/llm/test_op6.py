"""WARC archives: exact round trips, member access, multi-member input, revisits."""
import gzip
import io
import zlib

import pytest

from seqloom.llm import op6_warc as op


def want(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        t = top.get(h or "") if i is not None else None
        again = i is not None and i < t
        out.append((i, len(p), op.digest(p), "revisit" if again else "response", t if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>x"), (2, "http://a/ 2\r\nX: y", "<p>x"), (3, None, None), (4, "u", ""), (5, "é", "größe\r\n\r\nWARC/1.1\r\n"), (6, "http://b", "z" * 3_000_000), (7, "http://b", "<p>x"), (7, "http://b", "<p>x"), (None, "n", "<p>x"), (8, "h", "z" * 3_000_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, refers_to string")
    pages = df.select("page_id", "url", "html")
    raw = op.write_archives(op.with_revisits(pages), f"file://{tmp_path}/raw")
    files = op.normalise(raw, f"file://{tmp_path}/out")
    got = [tuple(r) for r in op.read_archives(files).collect()]
    assert sorted(got, key=str) == want(ROWS)
    payloads = {}
    for r in files.collect():
        data = open(r["path"][7:], "rb").read()
        n = 0
        for line in open(r["index_path"][7:]):
            off, size, *_ = line.split("\t")
            rec = op.read_record(data[int(off): int(off) + int(size)])
            assert zlib.decompressobj(31).decompress(data[int(off):]).startswith(b"WARC/1.1\r\n")  # a member of its own
            if rec["record_type"] == "response":
                payloads[rec["page_id"]] = rec["payload"].decode()
            n += 1
        assert n == r["n_records"] and gzip.decompress(data).count(b"WARC-Record-ID") >= n
    for i, _, h in ROWS:
        if i in payloads:
            assert payloads[i] == (h or "")


def test_stream_reads_any_members():
    recs = [op.record(i, "u", b"p" * i * 1000) for i in range(50)]
    whole, split = gzip.compress(b"".join(recs)), b"".join(gzip.compress(r) for r in recs)
    for raw in (whole, split):
        assert [r for _, r in op.records(op.Stream(io.BytesIO(raw)))] == recs
    with pytest.raises(EOFError):
        list(op.records(op.Stream(io.BytesIO(whole[:-40]))))


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    sql = con.execute(op.SQL).fetchall()
    assert sorted(map(tuple, op.query(spark, sf).collect())) == sorted(sql)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    raw = op.write_archives(op.with_revisits(df), op.scratch_dir(spark, "t"))
    assert op.read_archives(op.normalise(raw, op.scratch_dir(spark, "t"))).collect() == []
