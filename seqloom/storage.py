"""Tables in the scratch folder that all executors share."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .errors import SeqError

_own: dict[str, str] = {}

#: Hadoop's names of stores, and those by which pyarrow opens them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and its place there, for Python code on executors."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary folder stands in for it in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SeqError("usage", f"spark.checkpoint.dir is unset, and executors of {master} share no folder")
        if spark.sparkContext.applicationId not in _own:
            folder = tempfile.mkdtemp(prefix="scratch-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[spark.sparkContext.applicationId] = f"file://{folder}"
        base = _own[spark.sparkContext.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read again: the lineage ends here."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
