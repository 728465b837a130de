"""Sections and chunks of Markdown, and the text that places a document on the map."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import fixed
from ..functions import text as tx
from .catalog import spread_sample

HEADING = r"(?m)^(#{1,6})\s+(.*)$"


def sections(markdown: Column) -> Column:
    """Array of (title, level, body); what stands before the first heading has no title.

    A mark is put before every heading and the text cut there, all in the JVM.
    """
    marked = F.regexp_replace(markdown, r"(?m)^(?=#{1,6}\s+.*$)", "\u0000")
    parts = F.filter(F.transform(F.split(marked, "\u0000"), lambda p: F.struct(F.regexp_extract(p, r"^(#{1,6})\s+(.*)", 1).alias("marks"), p.alias("raw"))), lambda s: F.length(tx.strip(s["raw"])) > 0)

    def part(s: Column) -> Column:
        titled = F.length(s["marks"]) > 0
        title = F.when(titled, tx.strip(F.regexp_extract(s["raw"], r"^#{1,6}\s+(.*)", 1)))
        body = F.when(titled, F.regexp_replace(s["raw"], r"^#{1,6}\s+.*", "")).otherwise(s["raw"])
        return F.struct(title.alias("title"), F.length(s["marks"]).alias("level"), tx.strip(body).alias("body"))

    return F.transform(parts, part)


#: Where a text may be cut, best first: after the last of these in the second half of a piece.
BREAKS = ("\n\n", ". ", "\n")


def split_long(text: str, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters that overlap, cut after a paragraph, sentence or line of the second half if there is one.

    All places where each mark ends are found in one scan; pieces then are slices between places that are looked up.
    """
    ends = {mark: np.array([m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)], int) for mark in BREAKS}

    def last_break(low: int, high: int) -> int:
        """The end of the best mark that lies whole between two places, else the upper one."""
        for mark, places in ends.items():
            k = int(places.searchsorted(high, "right"))
            if k and places[k - 1] >= low + len(mark):
                return int(places[k - 1])
        return high

    cuts, start = [], 0
    while start + size < len(text):
        end = last_break(start + size // 2, start + size)
        cuts.append((start, end))
        start = max(end - overlap, start + 1)
    return [text[a:b] for a, b in [*cuts, (start, len(text))]]


@udtf(returnType=StructType([StructField("ord", IntegerType()), StructField("text", StringType())]))
class SplitLong:
    """Table function: the overlapping pieces of a long text."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(split_long(text))


@F.udf(ArrayType(StringType()), useArrow=False)
def _pieces(body):
    """Bodies reach Python a hundred at a time, whatever their number."""
    return [] if body is None else split_long(body)


def chunk_markdown(documents: DataFrame, key: str, markdown: str = "markdown", most: int | None = None) -> DataFrame:
    """(key, ord, section, text): all chunks of each document, none across a section's border.

    Sections that say nothing of the subject, and texts under 120 characters, are left out.  Where a caller asks for ``most``
    chunks of a document, every section keeps its first before any keeps its second.
    """
    w = Window.partitionBy(key)
    rows = documents.select(key, F.posexplode(sections(F.col(markdown))).alias("place", "s")).select(key, "place", F.col("s.title").alias("section"), F.col("s.body").alias("body"))
    rows = rows.where(~tx.boilerplate_heading(F.col("section")) & (F.length("body") >= fixed.MIN_CHUNK_CHARS))
    short = F.length("body") <= fixed.CHUNK_CHARS  # most sections never leave the JVM
    cut = rows.where(short).select(key, "place", "section", F.array("body").alias("pieces")).unionByName(rows.where(~short).select(key, "place", "section", _pieces("body").alias("pieces")))
    pieces = cut.select(key, "place", "section", F.posexplode("pieces").alias("depth", "text")).withColumn("text", tx.strip(F.col("text"))).where(F.length("text") >= fixed.MIN_CHUNK_CHARS)
    pieces = pieces.withColumn("depth", F.row_number().over(Window.partitionBy(key, "place").orderBy("depth")))
    if most is not None:
        pieces = pieces.withColumn("turn", F.row_number().over(w.orderBy("depth", "place"))).where(F.col("turn") <= most)
    return pieces.select(key, (F.row_number().over(w.orderBy("place", "depth")) - 1).alias("ord"), "section", "text")


def document_texts(papers: DataFrame, key: str) -> DataFrame:
    """(key, text): title, abstract, summary and up to twenty headings, at most 6,000 characters.

    Input: key, title, abstract, summary, markdown, each of which may be null.
    """
    heads = papers.where(F.col("markdown").isNotNull()).select(key, F.posexplode(sections(F.col("markdown"))).alias("place", "s")).select(key, "place", F.col("s.title").alias("title"))
    heads = heads.where((F.length("title") > 0) & ~tx.boilerplate_heading(F.col("title")))
    heads = spread_sample(heads, [key], "place", fixed.MAX_HEADINGS)
    listed = heads.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "; ").alias("headings"))
    joined = papers.join(listed, key, "left")
    parts = [tx.strip(F.col(c)) for c in ("title", "abstract", "summary")]
    parts.append(F.concat(F.lit("Sections: "), "headings"))
    return joined.select(key, F.substring(tx.concat_present("\n\n", *parts), 1, fixed.MAX_DOCUMENT_CHARS).alias("text"))


_HEADING = re.compile(HEADING)


def headings(markdown: str) -> list[str]:
    return [m[2].strip() for m in _HEADING.finditer(markdown)]
