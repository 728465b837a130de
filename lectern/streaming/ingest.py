"""A watched folder as a stream of files, registered once each by content.

The file source with a checkpoint sees every file once, and a start with ``availableNow`` is
the rescan; debouncing is a session window; identity by content makes all of it idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.library import content_digest, document_kind

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the documents that appear under a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows.withColumn("kind", document_kind(F.col("path"), F.col("content"))).where(F.col("kind").isNotNull()).withColumn("digest", content_digest())


def settled(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(path, first, last, n): bursts of changes of one path, ended once nothing came for ``gap``.

    The deadline moves with every change; works on streams (with a watermark) and on tables.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return grouped.select("path", "first", "last", "n")


def register(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """(path, digest, outcome): created, moved (the known path is gone), or duplicate_content.

    ``known`` has path, digest and present (whether the file is still there).  Of new files of equal content
    the first by path is created.
    """
    k = known.groupBy("digest").agg(F.min("path").alias("known_path"), F.max("present").alias("present"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("path"))
    rows = arrived.select("path", "digest").distinct().withColumn("r", first).join(k, "digest", "left")
    same = F.col("known_path") == F.col("path")
    outcome = (
        F.when(F.col("known_path").isNull() & (F.col("r") == 1), "created")
        .when(same, "unchanged")
        .when(F.col("known_path").isNotNull() & ~F.col("present") & (F.col("r") == 1), "moved")
        .otherwise("duplicate_content")
    )
    return rows.select("path", "digest", outcome.alias("outcome"))


def register_stream(stream: DataFrame, table_path: str, checkpoint: str):
    """Appends every batch's new documents to a Parquet table, at most once per content; returns the query."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(table_path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            known = spark.createDataFrame([], "path string, digest string, kind string, size long")
        fresh = df.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
        fresh.select("path", "digest", "kind", "size").write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def place_or_refit(placed: DataFrame) -> str:
    """What a batch of new vectors calls for."""
    from ..operators.catalog import should_refit

    return "refit" if should_refit(placed).first()["refit"] else "place"


def live_counts(events: DataFrame, late: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Counts of events by kind in tumbling windows, as a stream or over a table (an extension: the library has no event time)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
