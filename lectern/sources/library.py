"""Documents of a folder: recursive scan, recognition by content, digests, upload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(column: str = "content") -> Column:
    return F.sha2(F.col(column), 256)


def document_kind(path: Column, content: Column) -> Column:
    """What a file is by its first bytes, else by its extension; null if neither tells.

    Zip containers are told apart by extension.  Unreadable files (null content) go by extension alone.
    """
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    begins = lambda magic, at=1: F.substring(content, at, len(magic)) == F.lit(magic)
    by_name = F.when(suffix == "pdf", "pdf").when(suffix.isin("djvu", "djv"), "djvu").when(suffix == "docx", "docx").when(suffix == "epub", "epub").when(suffix.isin("mobi", "azw", "azw3", "prc"), "mobi").when(suffix.isin("txt", "text"), "text").when(suffix.isin("md", "markdown"), "markdown")
    by_content = (
        F.when(begins(b"%PDF-"), "pdf")
        .when(begins(b"AT&T"), "djvu")
        .when(begins(b"BOOKMOBI", 61) | begins(b"TEXtREAd", 61), "mobi")
        .when(begins(b"PK\x03\x04") & suffix.isin("docx", "epub"), suffix)
        .when(suffix.isin("txt", "text", "md", "markdown"), by_name)
    )
    return F.when(content.isNull(), by_name).otherwise(by_content)


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, content, kind, digest) of the documents under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows.withColumn("kind", document_kind(F.col("path"), F.col("content"))).where(F.col("kind").isNotNull()).withColumn("digest", content_digest())


def upload_name(name: Column) -> Column:
    """A file name without folders, with letters, digits, dots, dashes and spaces alone."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.substring(F.trim(F.regexp_replace(base, r"[^A-Za-z0-9._ -]", "_")), 1, 180)


def upload_problem(name: Column, size: Column, content: Column, most: int = 512 << 20) -> Column:
    """Why a file is refused: too large, empty, or not a document; null if it is taken."""
    return F.when(size > most, "too large").when(size == 0, "empty").when(document_kind(name, content).isNull(), "not a document")


def shard_path(paper_id: Column) -> Column:
    return F.format_string("%03d/%06d.md", F.floor(paper_id / 1000), paper_id)
