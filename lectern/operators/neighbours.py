"""Nearest neighbours by cosine, exact.

Up to PAIRS pairs of blocks of vectors every pair is compared, in a grid of parts (``pairs``).  Beyond, vectors are
kept in cells (``cells``), and pairs that can't hold a neighbour are left out; the rows are the same.  No side is broadcast and no
task holds more than a part of the queries and a block of vectors; what is gathered per row is k candidates for each part of the vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import dot, norm, unit
from . import cells, pairs

BLOCK_ROWS = 1024
#: Pairs of blocks up to which comparing all of them costs less than fitting centres.
PAIRS = 1024


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, skip_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, similarity, rank) of the k nearest vectors of every query; ties fall by lower id.

    Both inputs have ``id`` and ``v``.  ``least`` drops less similar pairs, after the k are chosen.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], f"{pairs.FOUND}, rank int")
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first() for df in ((queries,) if queries is vectors else (queries, vectors))]
    n_left, n_right, dim = sizes[0]["n"], sizes[-1]["n"], max(s["dim"] or 1 for s in sizes)
    blocks = [max(1, -(-n // block_rows)) for n in (n_left, n_right)]
    if blocks[0] * blocks[1] > PAIRS:
        index = cells.build(vectors, blocks[1] * block_rows, block_rows=block_rows)
        asked = index if queries is vectors else cells.assign(queries, index.centres, block_rows)
        return cells.top_k(asked, index, k, least, skip_self, asked=n_left)
    parts = pairs.parts_for(queries.sparkSession.sparkContext.defaultParallelism, n_left, n_right, dim)
    left, right = (pairs.packed(df.select(F.col("id").cast("long").alias("id"), unit(F.col("v")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("part"))) for df, n in zip((queries, vectors), parts, strict=True))
    return cells.ranked(pairs.best(pairs.dealt(left, right, *parts), k, least, skip_self), k)


def nearest(vectors: DataFrame, query: list[float], k: int, exclude: list[int] | None = None) -> DataFrame:
    """The k vectors most similar to one query; a query of no length has none."""
    q = np.asarray(query, float)
    size = float(np.linalg.norm(q))
    rows = vectors if not exclude else vectors.where(~F.col("id").isin(*exclude))
    if size < 1e-12:
        rows = rows.limit(0)
    similarity = dot(unit(F.col("v")), F.lit((q / max(size, 1e-12)).tolist()))
    return rows.select("id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def skeleton(vectors: DataFrame, k: int = fixed.SKELETON_K, least: float = fixed.MIN_EDGE_SIMILARITY) -> DataFrame:
    """Undirected edges (a < b) from every vector to its k nearest of at least that similarity."""
    found = top_k(vectors, vectors, k, least)
    return found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct().orderBy("a", "b")


def neighbours_for(rows: int) -> int:
    """How many neighbours a corpus of that size gets: the lesser of rows / 8 and the root, from 5 to 60."""
    if rows < 2:
        return 5
    return min(max(5, min(60, round(min(rows / 8, rows**0.5)))), rows - 1)


def routing_edges(vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(a, b, distance), both directions: an edge wherever either end chose the other; 1 - similarity + 0.05."""
    if k is None:
        k = neighbours_for(vectors.count())
    found = top_k(vectors, vectors, k, fixed.MIN_EDGE_SIMILARITY)
    distance = (1 - F.col("similarity")) + fixed.HOP_PENALTY
    both = found.select(F.col("i").alias("a"), F.col("j").alias("b"), distance.alias("distance")).unionByName(found.select(F.col("j").alias("a"), F.col("i").alias("b"), distance.alias("distance")))
    return both.groupBy("a", "b").agg(F.max("distance").alias("distance"))


def drift(points: DataFrame, fitted: DataFrame, k: int = fixed.DRIFT_NEIGHBOURS) -> DataFrame:
    """(id, drift): mean distance to the k nearest fitted vectors, over the fitted ones' own median (without themselves).

    With k or fewer fitted vectors the median is unbounded and every drift is 0.
    """
    n = fitted.count()
    near = top_k(points, fitted, min(k, n), skip_self=False).groupBy(F.col("i").alias("id")).agg(F.avg(1 - F.col("similarity")).alias("away"))
    if n <= k:
        return near.select("id", F.lit(0.0).alias("drift"))
    own = top_k(fitted, fitted, k).groupBy("i").agg(F.avg(1 - F.col("similarity")).alias("away"))
    base = own.agg(F.greatest(F.percentile("away", 0.5), F.lit(1e-6)).alias("base"))
    return near.crossJoin(F.broadcast(base)).select("id", (F.col("away") / F.col("base")).alias("drift"))


__all__ = ["drift", "nearest", "neighbours_for", "norm", "routing_edges", "skeleton", "top_k"]
