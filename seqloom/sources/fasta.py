"""FASTA and FASTQ as a Spark data source, and sequence databases as Parquet tables."""
from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SeqError
from ..functions.udfs import fnv1a64
from ..operators.ranking import numbered
from ..storage import file_system

#: File endings, and the letters of nucleotide sequences.
FASTA_ENDINGS, FASTQ_ENDINGS = ("fa", "fasta", "faa", "fna"), ("fq", "fastq")
NUCLEOTIDES = "ACGTUNRYSWKMBDHV"
SPLIT = 128 << 20
_SPACE = bytes.maketrans(b"", b"")
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
_WHITE = b" \t\n\x0c\r"


def _head(path: str, n: int = 2) -> bytes:
    fs, where = file_system(path)
    with fs.open_input_stream(where, compression=None) as f:
        return f.read(n)


def is_gzip(path: str) -> bool:
    return path.endswith(".gz") or _head(path) == b"\x1f\x8b"


def detect_format(path: str) -> str:
    """'fasta' or 'fastq', by the ending (through .gz), else by the first byte."""
    end = path.removesuffix(".gz").rpartition(".")[2].lower()
    if end in FASTA_ENDINGS:
        return "fasta"
    if end in FASTQ_ENDINGS:
        return "fastq"
    with _open(path) as f:
        first = f.read(1)
    if not first:
        raise SeqError("io", f"{path}: the file is empty")
    if first not in (b">", b"@"):
        raise SeqError("parse", f"{path}: unknown sequence format")
    return "fasta" if first == b">" else "fastq"


def _open(path: str, start: int = 0):
    fs, where = file_system(path)
    if is_gzip(path):
        return gzip.GzipFile(fileobj=fs.open_input_stream(where, compression=None))
    f = fs.open_input_file(where)
    f.seek(start)
    return io.BufferedReader(f, 1 << 20) if hasattr(f, "readinto") else f


def clean(seq: bytes) -> str:
    return seq.translate(_UPPER, _WHITE).decode("ascii", "replace")


def parse_fasta(lines, where: str = "", at: int = 0):
    """(offset, name, sequence) of lines of bytes.

    Headers are taken whole; white space in sequences goes; blank lines are skipped; a header
    without a sequence is an empty sequence; data before the first header is an error.
    """
    name, parts, begin = None, [], at
    for line in lines:
        size = len(line)
        body = line.rstrip(b"\r\n")
        if body.startswith(b">"):
            if name is not None:
                yield begin, name, clean(b"".join(parts))
            name, parts, begin = body[1:].strip().decode("utf-8", "replace"), [], at
        elif body.strip():
            if name is None:
                raise SeqError("parse", f"{where}: sequence data before the first header")
            parts.append(body)
        at += size
    if name is not None:
        yield begin, name, clean(b"".join(parts))


def parse_fastq(lines, where: str = ""):
    """(record, name, sequence); sequences and qualities may take several lines."""
    lines = (x.rstrip(b"\r\n") for x in lines)
    n = 0
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"@"):
            raise SeqError("parse", f"{where}: record {n} does not begin with @")
        name, seq, qual = line[1:].strip().decode("utf-8", "replace"), b"", b""
        for line in lines:
            if line.startswith(b"+"):
                break
            seq += line
        else:
            raise SeqError("parse", f"{where}: record {n} has no quality")
        while len(qual) < len(seq):
            try:
                qual += next(lines)
            except StopIteration:
                raise SeqError("parse", f"{where}: record {n} ends early") from None
        if len(qual) != len(seq):
            raise SeqError("parse", f"{where}: record {n} has {len(seq)} letters and {len(qual)} qualities")
        if any(not 33 <= c <= 126 for c in qual):
            raise SeqError("parse", f"{where}: record {n} has a quality out of range")
        yield n, name, clean(seq)
        n += 1


class _Range(InputPartition):
    def __init__(self, file: int, path: str, kind: str, start: int, stop: int | None):
        self.file, self.path, self.kind, self.start, self.stop = file, path, kind, start, stop


def _own_lines(f, start: int, stop: int):
    """Lines of the records that begin in a byte range; the first line is at a record's start."""
    at = start
    for line in f:
        if at >= stop and line.startswith(b">"):
            return
        yield line
        at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options, kind):
        self.paths = [p for p in options["path"].split(",") if p]
        self.kind = kind
        self.split = int(options.get("splitbytes", SPLIT))

    def partitions(self):
        out = []
        for i, path in enumerate(self.paths):
            kind = detect_format(path) if self.kind == "sequences" else self.kind
            if kind == "fastq" or is_gzip(path):
                out.append(_Range(i, path, kind, 0, None))
                continue
            fs, where = file_system(path)
            size = fs.get_file_info(where).size
            out += [_Range(i, path, kind, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return out

    def read(self, part):
        if part.kind == "fastq":
            rows = parse_fastq(_open(part.path), part.path)
        elif part.stop is None:
            rows = parse_fasta(_open(part.path), part.path)
        else:
            begin = max(part.start - 1, 0)
            f = _open(part.path, begin)
            if part.start:  # go on to the first header that begins in the range
                begin += len(f.readline())
                while begin < part.stop and (line := f.readline()):
                    if line.startswith(b">"):
                        f = _open(part.path, begin)
                        break
                    begin += len(line)
                else:
                    return
                if begin >= part.stop:
                    return
            rows = parse_fasta(_own_lines(f, begin, part.stop), part.path, begin)
        batch: list = []
        size = 0
        for at, name, seq in rows:
            batch.append((part.file, at, name, seq))
            size += len(seq)
            if len(batch) >= 4096 or size > 16_000_000:
                yield self._arrow(batch)
                batch, size = [], 0
        if batch:
            yield self._arrow(batch)

    @staticmethod
    def _arrow(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["file", "at", "name", "seq"])


class SequenceSource(DataSource):
    """``spark.read.format("sequences").load("a.fasta,b.fq.gz")``: (file, at, name, seq)."""

    @classmethod
    def name(cls):
        return "sequences"

    def schema(self):
        return "file int, at long, name string, seq string"

    def reader(self, schema):
        return _Reader(self.options, self.name())


class FastaSource(SequenceSource):
    @classmethod
    def name(cls):
        return "fasta"


class FastqSource(SequenceSource):
    @classmethod
    def name(cls):
        return "fastq"


def register(spark: SparkSession) -> None:
    for s in (SequenceSource, FastaSource, FastqSource):
        spark.dataSource.register(s)


def read_sequences(spark: SparkSession, path: str, kind: str = "sequences", split: int = SPLIT) -> DataFrame:
    """(seq_id, name, seq): ids count the records in the order of files and records."""
    register(spark)
    raw = spark.read.format(kind).option("splitBytes", split).load(path)
    return numbered(raw, "seq_id").select("seq_id", "name", "seq")  # splits come in the order of files and places


def dbtype_of(seqs: DataFrame):
    """Aggregate: 'nucleotide' if every sequence has nucleotide letters only (also if there is none)."""
    return F.when(F.coalesce(F.bool_and(F.col("seq").rlike(f"^[{NUCLEOTIDES}]*$")), F.lit(True)), "nucleotide").otherwise("protein")


def check_sequences(seqs: DataFrame, dbtype: str, longest: int | None) -> DataFrame:
    """``seqs`` whose reading fails at letters outside the type's alphabet or at too long ones."""
    letters = {"protein": "^[A-Z*-]*$", "nucleotide": f"^[{NUCLEOTIDES}]*$"}.get(dbtype)
    seq = F.col("seq")
    if letters is not None:
        seq = F.when(seq.rlike(letters), seq).otherwise(F.raise_error(F.concat(F.lit(f"KC1004 not a {dbtype} sequence: "), F.col("name"))))
    if longest is not None:
        seq = F.when(F.length("seq") <= longest, seq).otherwise(F.raise_error(F.concat(F.lit(f"KC1004 longer than {longest}: "), F.col("name"))))
    return seqs.withColumn("seq", seq)


def meta(seqs: DataFrame, dbtype: str = "auto") -> DataFrame:
    """One row: version, dbtype, n_seqs, total_bases, max_seq_len, encoding, endian."""
    kind = dbtype_of(seqs) if dbtype == "auto" else F.lit(dbtype)
    n = F.length("seq")
    return seqs.agg(
        F.lit(1).alias("version"), kind.alias("dbtype"), F.count("*").alias("n_seqs"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_bases"),
        F.coalesce(F.max(n), F.lit(0)).cast("int").alias("max_seq_len"), F.lit("ascii_upper").alias("encoding"), F.lit("little").alias("endian"),
    )


def createdb(spark: SparkSession, path: str, out: str, dbtype: str = "auto", longest: int | None = None) -> dict:
    """Read, check and store sequences; returns the metadata."""
    seqs = check_sequences(read_sequences(spark, path), dbtype, longest)
    try:
        seqs.withColumn("seq_len", F.length("seq")).withColumn("checksum", fnv1a64("seq")).write.mode("overwrite").parquet(f"{out}/sequences")
    except Exception as e:
        text = str(e)
        if "KC1004" in text:
            raise SeqError("validation", text[text.index("KC1004") + 7:].split("\n")[0][:200]) from None
        raise
    m = meta(spark.read.parquet(f"{out}/sequences"), dbtype)
    m.coalesce(1).write.mode("overwrite").parquet(f"{out}/db_meta")
    return load_meta(spark, out)


def load_meta(spark: SparkSession, db: str) -> dict:
    return spark.read.parquet(f"{db}/db_meta").first().asDict()


def load_db(spark: SparkSession, db: str) -> DataFrame:
    return spark.read.parquet(f"{db}/sequences")


def is_db(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return all(p(f"{path}/{x}").getFileSystem(conf).exists(p(f"{path}/{x}")) for x in ("sequences", "db_meta"))
