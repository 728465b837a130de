"""Functions of the library by their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import chunks, metadata
from ..sources import html


def register(spark: SparkSession) -> None:
    """Adds ``split_long(text)`` as a table function, and ``html_markdown``, ``title_of``, ``synopsis_of`` and ``excerpt_of`` as functions of one text."""
    spark.udtf.register("split_long", chunks.SplitLong)
    for name, function in (("html_markdown", html.markdown_of), ("title_of", metadata.title_of), ("synopsis_of", metadata.synopsis_of), ("excerpt_of", metadata.excerpt_of)):
        spark.udf.register(name, function)
