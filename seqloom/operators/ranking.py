"""Dense positions in a global order without a single-partition window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the given order.

    A range partitioning sorts globally; only one count for each partition is added up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order in which its rows stand; nothing is moved.

    The rows are written as they are, and each partition's rows are counted.
    """
    ranged = stored(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = counts.select("__part", "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # ids of one partition are consecutive, so the row's place in it is a difference
    joined = ranged.join(F.broadcast(before), "__part")  # one row for each partition
    return joined.withColumn(name, (F.col("__before") + F.col("__row") - F.col("__first")).cast("long")).drop("__part", "__row", "__first", "__before")
