"""Neighbour search over cells: vectors around the centres of a k-means, with bounds that leave cells out.

A cell holds the unit vectors nearest to one centre, in blocks of bounded size; each block knows how near and how far from the
centre its vectors are.  For a vector x at distance d from q, similarity is (|q|^2 + |x|^2 - d^2) / 2, and d is at least
what the distance of q to the centre exceeds the block's range by, so a block has a greatest similarity to q that costs one distance to a centre.

*Exact*: every query meets its own and the nearest cells until those hold more than k vectors; the k-th best similarity so far is what a
cell has to be able to reach.  Cells that can't for any query of a block are left out, and queries that a cell can't serve aren't compared with it.

*Approximate*: every query meets the cells of the ``probes`` centres nearest to it.

Centres are fitted on at most FIT_ROWS vectors for each cell; every vector is indexed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import materialize
from ..functions.vectors import unit
from . import pairs

BLOCK_ROWS = 1024
#: Cells at most (their centres go to every task), and vectors that centres are fitted on, for each cell.
MOST_CELLS, FIT_ROWS = 4096, 64


class Cells(NamedTuple):
    """Centres, and rows (id, v of length one, cell, away: distance from the centre, block)."""

    centres: np.ndarray
    rows: DataFrame


def cells_for(rows: int) -> int:
    """How many cells: the root of the rows, at most MOST_CELLS."""
    return max(1, min(MOST_CELLS, round(rows**0.5)))


def fit_centres(vectors: DataFrame, cells: int, seed: int = 17) -> np.ndarray:
    """Centres of unit vectors, by k-means on the first FIT_ROWS * cells in the order of a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = vectors.where(F.col("v").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS * cells)
    rows = chosen.select(array_to_vector(unit(F.col("v"))).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=6, initMode="random").fit(rows).clusterCenters())


def assign(vectors: DataFrame, centres: np.ndarray, block_rows: int = BLOCK_ROWS) -> Cells:
    """Every vector with its cell; a cell of many vectors is dealt into blocks by id, so none is gathered whole."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def run(batches):
        centres = shared.value
        size = (centres**2).sum(axis=1)
        for batch in batches:
            n = len(batch)
            flat = batch.column(1)
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, centres.shape[1]))
            cell, away = np.zeros(n, np.int64), np.zeros(n)
            for i in range(0, n, 1024):
                square = (v[i : i + 1024] ** 2).sum(axis=1)[:, None] + size - 2 * v[i : i + 1024] @ centres.T
                cell[i : i + 1024] = square.argmin(axis=1)
                away[i : i + 1024] = np.sqrt(np.maximum(square.min(axis=1), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(cell), pa.array(away)], names=["id", "v", "cell", "away"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), unit(F.col("v")).alias("v")).mapInArrow(run, "id long, v array<double>, cell long, away double")
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    rows = rows.join(F.broadcast(blocks), "cell")  # a row for each cell
    return Cells(centres, rows.select("id", "v", "cell", "away", F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("block")))


def build(vectors: DataFrame, rows: int, cells: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 17) -> Cells:
    return assign(vectors, fit_centres(vectors, cells or cells_for(rows), seed), block_rows)


def packed(rows: DataFrame, *more: str) -> DataFrame:
    """(cell, block, ids, matrix, low, high, and the named columns packed): one row per block."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        away = table["away"].to_numpy()
        values = {"ids": table["id"].to_numpy(), "matrix": table["v"].combine_chunks().flatten().to_numpy()} | {c: table[c].to_numpy() for c in more}
        found = {"cell": pa.array([table["cell"][0].as_py()], pa.int64()), "block": pa.array([table["block"][0].as_py()], pa.int64()), "low": pa.array([away.min()]), "high": pa.array([away.max()])}
        return pa.table(found | {k: pa.array([v.tobytes()], pa.binary()) for k, v in values.items()})

    kinds = ", ".join(["cell long, block long, low double, high double, ids binary, matrix binary", *(f"{c} binary" for c in more)])
    return rows.groupBy("cell", "block").applyInArrow(pack, kinds)


def best_of(ids_a: np.ndarray, ids_b: np.ndarray, s: np.ndarray, k: int, least: float | None, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the k best columns of each row of ``s``, by falling similarity (12 digits), then lower id."""
    if skip_self:
        s[ids_a[:, None] == ids_b[None, :]] = -np.inf
    if k < s.shape[1]:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero(s >= edge[:, None] - 1e-12)
        order = np.lexsort((ids_b[column], -np.round(s[row, column], 12), row))
        row, column = row[order], column[order]
        heads = np.searchsorted(row, np.arange(len(ids_a)))
        first = np.arange(len(row)) - heads[row] < k
        row, column = row[first], column[first]
    else:
        row, column = (x.reshape(-1) for x in np.indices(s.shape))
    found = s[row, column]
    keep = found >= (-2 if least is None else least)
    return ids_a[row[keep]], ids_b[column[keep]], found[keep]


def _compared(k: int, least: float | None, skip_self: bool):
    """Blocks of queries (or the ``rows`` of them that need it) against blocks of vectors."""

    def run(batches):
        for batch in batches:
            parts = []
            for row in batch.to_pylist():
                ids_a, ids_b = np.frombuffer(row["ids_a"], np.int64), np.frombuffer(row["ids_b"], np.int64)
                a, b = np.frombuffer(row["m_a"]).reshape(len(ids_a), -1), np.frombuffer(row["m_b"]).reshape(len(ids_b), -1)
                if row["rows"] is not None:
                    some = np.frombuffer(row["rows"], np.int32)
                    ids_a, a = ids_a[some], a[some]
                parts.append(best_of(ids_a, ids_b, a @ b.T, k, least, skip_self))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "similarity"])

    return run


_FOUND = pairs.FOUND


def _bounds(square: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest similarity that vectors of each cell can have to each query, from squared distances to centres."""
    away = np.sqrt(np.maximum(square, 0))
    short = np.maximum(np.maximum(away - high, low - away), 0)
    return (lengths[:, None] + 1 - short**2) / 2


def _needed(shared, probes: int | None):
    """For each block of queries: the cells to meet, and the rows that have to."""

    def run(batches):
        centres, low, high = shared.value
        size = (centres**2).sum(axis=1)
        for batch in batches:
            cells, blocks, to, rows = [], [], [], []
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                v = np.frombuffer(row["matrix"]).reshape(n, -1)
                lengths = (v**2).sum(axis=1)
                square = lengths[:, None] + size - 2 * v @ centres.T
                if probes is None:
                    need = _bounds(square, lengths, low, high) >= np.frombuffer(row["reach"])[:, None] - pairs.SLACK
                else:
                    square = np.where(np.isfinite(high), square, np.inf)
                    nearest = np.argpartition(square, min(probes, len(centres)) - 1, axis=1)[:, :probes]
                    need = np.zeros(square.shape, bool)
                    need[np.arange(n)[:, None], nearest] = True
                need &= np.isfinite(high)  # a cell without vectors has no range
                for c in np.flatnonzero(need.any(axis=0)).tolist():
                    cells.append(row["cell"])
                    blocks.append(row["block"])
                    to.append(c)
                    rows.append(np.flatnonzero(need[:, c]).astype(np.int32).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((cells, blocks, to, rows), kinds, strict=True)], names=["cell_a", "block_a", "cell_b", "rows"])

    return run


def _side(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(F.col("cell").alias(f"cell_{side}"), F.col("block").alias(f"block_{side}"), F.col("ids").alias(f"ids_{side}"), F.col("matrix").alias(f"m_{side}"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy(F.desc(F.round("similarity", 12)), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranges_of(vectors: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How near and how far from the centre each cell's vectors are, and how many the first block has."""
    centres = vectors.centres
    ranges = vectors.rows.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("n")).collect()  # a row for each cell
    low, high, n = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for r in ranges:
        low[r.cell], high[r.cell], n[r.cell] = r.low, r.high, r.n
    return low, high, n


def reached(queries: Cells, vectors: Cells, n: np.ndarray, k: int, least: float | None, skip_self: bool) -> DataFrame:
    """The queries' rows with ``reach``, what the k-th best has to beat: that of the first blocks of the nearest cells that hold more than k vectors together."""
    spark, centres = vectors.rows.sparkSession, vectors.centres
    away = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2) if len(centres) <= 512 else (centres**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * centres @ centres.T
    order = np.argsort(away, axis=1, kind="stable")
    seeds = []
    for a in range(len(centres)):
        held = np.cumsum(n[order[a]])
        enough = int(np.searchsorted(held, k + 1)) + 1
        seeds += [(a, int(b)) for b in order[a][:enough] if n[b]]
    seeded = spark.createDataFrame(seeds, "cell_a long, cell_b long") if seeds else spark.createDataFrame([], "cell_a long, cell_b long")
    first = _side(packed(vectors.rows.where("block = 0")), "b").drop("block_b")
    near = seeded.join(_side(packed(queries.rows), "a"), "cell_a").join(first, "cell_b").select("ids_a", "m_a", "ids_b", "m_b", F.lit(None).cast("binary").alias("rows"))
    near = ranked(near.mapInArrow(_compared(k, None, skip_self), _FOUND), k)
    reach = near.groupBy(F.col("i").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("reach"))
    reach = materialize(reach, "cells-reach")  # two numbers a query; what it took to find them needn't lie beside what comparing moves
    return queries.rows.join(reach, "id", "left").withColumn("reach", F.greatest(F.coalesce("reach", F.lit(-2.0)), F.lit(-2.0 if least is None else float(least))))


def plan(queries: Cells, vectors: Cells, k: int, least: float | None, skip_self: bool, probes: int | None) -> DataFrame:
    """(cell_a, block_a, cell_b, rows): which blocks of queries meet which cells, and which of their rows."""
    low, high, n = ranges_of(vectors)
    shared = vectors.rows.sparkSession.sparkContext.broadcast((vectors.centres, low, high))
    kinds = "cell_a long, block_a long, cell_b long, rows binary"
    if probes is not None:
        return packed(queries.rows).mapInArrow(_needed(shared, probes), kinds)
    return packed(reached(queries, vectors, n, k, least, skip_self), "reach").mapInArrow(_needed(shared, None), kinds)


def top_k(queries: Cells, vectors: Cells, k: int, least: float | None = None, skip_self: bool = True, probes: int | None = None, asked: int | None = None) -> DataFrame:
    """(i, j, similarity, rank) of the k nearest vectors of every query; ties fall by lower id.

    Exact without ``probes``: the same rows as comparing all pairs; blocks of vectors go through parts of the queries (``pairs``) and past those that they
    can't serve.  Ids of queries are taken as distinct.  ``least`` drops less similar pairs.  Queries and vectors share their centres.  ``asked`` is
    the number of queries, where it is known.
    """
    if probes is None:
        spark, centres = vectors.rows.sparkSession, vectors.centres
        _, _, n = ranges_of(vectors)
        parts = pairs.parts_for(spark.sparkContext.defaultParallelism, queries.rows.count() if asked is None else asked, 2 * pairs.LEAST_ROWS, centres.shape[1])
        part = lambda k: F.pmod(F.xxhash64("cell", "block"), F.lit(parts[k])).alias("part")
        left = packed(reached(queries, vectors, n, k, least, skip_self), "reach").select(part(0), "ids", "matrix", "reach")
        right = packed(vectors.rows).select(part(1), "ids", "matrix", "cell", "low", "high")
        return ranked(pairs.best(pairs.dealt(left, right, *parts), k, least, skip_self, spark.sparkContext.broadcast(centres)), k)
    work = plan(queries, vectors, k, least, skip_self, probes)
    work = work.join(_side(packed(queries.rows), "a"), ["cell_a", "block_a"]).join(_side(packed(vectors.rows), "b"), "cell_b")
    found = work.select("ids_a", "m_a", "ids_b", "m_b", "rows").mapInArrow(_compared(k, least, skip_self), _FOUND)
    return ranked(found, k)
