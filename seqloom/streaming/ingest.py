"""Streams of sequences into an index, and streams of queries against it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexOptions, SearchOptions
from ..operators.index import Index
from ..operators.ranking import dense_index
from ..operators.search import search


def append_segments(stream: DataFrame, index: Index, opts: IndexOptions, checkpoint: str, **trigger):
    """Each micro-batch of ``stream`` (name, seq) becomes a segment of ``index``.

    A batch that runs again after a failure finds its own segment by the batch's path mark and is
    passed over, so every batch is in the index once.
    """

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        mark = f"stream:{checkpoint}:{number}"
        seqs = dense_index(df.select("name", "seq"), [F.asc("name"), F.asc("seq")], "seq_id")
        if not index.exists():
            index.build(seqs, opts, db_path=mark)
        elif not any(r["db_path"] == mark for r in index.rows()):
            index.update(seqs, opts, db_path=mark)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(stream: DataFrame, index: Index, opts: SearchOptions, out: str, checkpoint: str, **trigger):
    """Hits of each micro-batch of queries (query_id, seq), as Parquet below ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        queries = dense_index(df.select("query_id", "seq"), [F.asc("query_id"), F.asc("seq")], "q")
        search(index, queries, opts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
