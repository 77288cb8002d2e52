"""Result files: cluster tables, representative sequences and hits, in their exact order."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: letters in a line of a FASTA file.
LINE = 60


def _lines(df: DataFrame, order: list, line, path: str) -> None:
    """One text row for each row; part files in name order hold the global order."""
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """cluster_id, rep_id, member_id, tab-separated, by cluster and member."""
    _lines(clusters, ["cluster_id", "member_id"], F.concat_ws("\t", "cluster_id", "rep_id", "member_id"), path)


def fasta_lines(name, seq):
    wrapped = F.regexp_replace(seq, f"(.{{{LINE}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), name, F.when(seq == "", F.lit("")).otherwise(F.concat(F.lit("\n"), wrapped)))


def write_fasta(reps: DataFrame, path: str) -> None:
    """``reps`` (cluster_id, name, seq) in the order of clusters."""
    _lines(reps, ["cluster_id"], fasta_lines(F.col("name"), F.col("seq")), path)


def hit_line():
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    return F.concat_ws("\t", "query_id", "target_id", "score", six("identity"), six("coverage"), "seed_hits", "segment_id", "explain", "target_name", "local_id")


def write_hits(hits: DataFrame, path: str) -> None:
    """Ranked hits in the order of the queries, ten columns, tab-separated."""
    _lines(hits, ["q", "rank"], hit_line(), path)


def write_report(report: dict, path: str, spark) -> None:
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
