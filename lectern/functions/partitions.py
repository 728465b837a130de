"""How rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

#: Rows of one range, about.
RANGE_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the input has fewer partitions than cores, for work that costs more than moving rows.

    Larger inputs, which have their partitions already, aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def indexed(df: DataFrame, *keys: str | Column, name: str = "place", range_rows: int = 0) -> DataFrame:
    """Adds the place of every row in the order of ``keys`` (0 for the first), and ``range``, the stretch of places it was numbered with.

    Rows are dealt out by ranges and sorted inside them; what goes through the driver is one count for each range.  Rows that tie stand in any
    order.  The table is written to the shared folder.
    """
    rows = df.count()
    parts = max(1, -(-rows // (range_rows or RANGE_ROWS)))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialize(dealt, "indexed")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).orderBy("range").collect()  # a row for each range
    shifts, before = [], 0
    for r in counts:
        shifts.append((r["range"], before - r["first"]))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(shifts, "range int, _shift long")
    return dealt.join(F.broadcast(offsets), "range").withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_shift")
