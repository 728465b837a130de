"""Comparing every query with every vector in a grid of parts.

Queries and vectors come in packed blocks, and blocks are dealt into parts.  A task holds one part of the queries with the k best of each so far,
and reads the blocks of one part of the vectors one after another: memory is bounded by PART_NUMBERS, a vector is written once and read once for each part of queries, and what is
gathered for a query is k candidates for each part of the vectors.  Blocks that know how near and how far from a centre their vectors are go past the queries that they can't serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the queries that one task holds at most, and queries or vectors that are worth a part of their own.
PART_NUMBERS, LEAST_ROWS = 1 << 21, 512
#: Parts of the vectors, where parts of the queries are fewer than cores.
VECTOR_PARTS = 2
#: Vectors that are compared at once, and queries.
WIDE, HIGH = 4096, 256
#: What rounding may cost a bound.
SLACK = 1e-6

FOUND = "i long, j long, similarity double"


def parts_for(cores: int, queries: int, vectors: int, dim: int) -> tuple[int, int]:
    """Parts of the queries and of the vectors: one of the queries for each core, more where a part would be too large."""
    asking = max(1, min(cores, queries // LEAST_ROWS), -(-queries * dim // PART_NUMBERS))
    return asking, 1 if asking >= cores else max(1, min(VECTOR_PARTS, vectors // LEAST_ROWS))


def packed(rows: DataFrame) -> DataFrame:
    """(part, ids, matrix) from (id, v, part), packed where they are."""

    def pack(batches):
        for batch in batches:
            ids, part = batch["id"].to_numpy(), batch["part"].to_numpy()
            matrix = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else None
            numbers = np.unique(part)
            of = [np.flatnonzero(part == p) for p in numbers]
            values = [pa.array([ids[k].tobytes() for k in of], pa.binary()), pa.array([matrix[k].tobytes() for k in of], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *values], names=["part", "ids", "matrix"])

    return rows.select("id", "v", F.col("part").cast("long").alias("part")).mapInArrow(pack, "part long, ids binary, matrix binary")


def dealt(queries: DataFrame, vectors: DataFrame, parts_a: int, parts_b: int) -> DataFrame:
    """Every part of the queries (part, ids, matrix and maybe reach) with every part of the vectors (part, ids, matrix and maybe cell, low, high); all queries before the second block of vectors.

    Each side is dealt into its parts once, and a task reads one part of either: in the product of the two, a block of vectors comes along with the first block of
    the queries, and a block of queries with the first one of the vectors.
    """
    kinds = {"reach": "binary", "cell": "long", "low": "double", "high": "double"}

    def side(df: DataFrame, parts: int, number: int) -> DataFrame:
        given = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        rows = df.repartitionById(parts, F.pmod(F.col("part"), F.lit(parts)).cast("int"))
        head = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition
        return rows.select(F.struct(F.lit(number).alias("side"), "ids", "matrix", *given).alias(f"row{number}"), F.col("part").alias(f"part{number}"), head.alias(f"head{number}"))

    both = side(vectors, parts_b, 1).join(side(queries, parts_a, 0).hint("shuffle_replicate_nl"), F.col("head0") | F.col("head1"))
    some = F.array_compact(F.array(F.when(F.col("head1"), F.col("row0")), F.when(F.col("head0"), F.col("row1"))))
    return both.select((F.col("part0") * parts_b + F.col("part1")).alias("pair"), F.explode(some).alias("row")).select("pair", "row.*")


class _Part:
    """A part of the queries, and the k best of each so far: by falling similarity (12 digits), then lower id."""

    def __init__(self, k: int, least: float | None, skip_self: bool, centres: np.ndarray | None):
        self.k, self.least, self.skip_self, self.centres = k, -2.0 if least is None else float(least), skip_self, centres
        self.asked, self.waiting, self.n_waiting, self.ids = [], [], 0, None

    def ask(self, ids: np.ndarray, matrix: np.ndarray, reach: np.ndarray | None) -> None:
        self.asked.append((ids, matrix, np.full(len(ids), -2.0) if reach is None else reach))

    def meet(self, ids: np.ndarray, matrix: np.ndarray, cell: int | None, low: float, high: float) -> None:
        if self.ids is None:
            if not self.asked:
                return
            self.ids, self.matrix, self.reach = (np.concatenate(x) for x in zip(*self.asked, strict=True))
            self.asked, self.lengths, self.narrow = [], (self.matrix**2).sum(axis=1), self.matrix.astype(np.float32)
            self.best, self.other = np.full((len(self.ids), self.k), -np.inf), np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        if self.centres is not None and cell is not None:
            centre = self.centres[cell]
            away = np.sqrt(np.maximum(self.lengths + centre @ centre - 2 * self.matrix @ centre, 0))
            bound = (self.lengths + 1 - np.maximum(np.maximum(away - high, low - away), 0) ** 2) / 2
            need = np.flatnonzero(bound >= np.maximum(np.maximum(self.reach, self.best[:, -1]), self.least) - SLACK)
            if 2 * len(need) < len(self.ids):
                self._compare(ids, matrix, need)
                return
        self.waiting.append((ids, matrix))
        self.n_waiting += len(ids)
        if self.n_waiting >= WIDE:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            ids, matrix = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.n_waiting = [], 0
            for i in range(0, len(ids), WIDE):
                self._compare(ids[i : i + WIDE], matrix[i : i + WIDE], np.arange(len(self.ids)))

    def _compare(self, ids: np.ndarray, matrix: np.ndarray, rows: np.ndarray) -> None:
        """Single precision finds the pairs that may be among the best, within what it may be off by; double precision decides."""
        own = np.isin(self.ids[rows], ids) if self.skip_self else None
        narrow, off = matrix.astype(np.float32).T, (matrix.shape[1] + 8) * 1.2e-7
        for i in range(0, len(rows), HIGH):
            part = rows[i : i + HIGH]
            s = self.narrow[part] @ narrow
            if own is not None:
                for k in np.flatnonzero(own[i : i + HIGH]):
                    s[k, ids == self.ids[part[k]]] = -np.inf
            beat = np.maximum(np.maximum(self.best[part, -1], self.reach[part]), self.least) - off
            if self.k < s.shape[1] and (beat < -1).any():
                beat = np.maximum(beat, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * off)
            row, column = np.divmod(np.flatnonzero(s >= beat.astype(np.float32)[:, None]), s.shape[1])
            if len(row):
                self._keep(part, row, ids[column], np.einsum("ij,ij->i", self.matrix[part[row]], matrix[column]))

    def _keep(self, part: np.ndarray, row: np.ndarray, other: np.ndarray, found: np.ndarray) -> None:
        hit, row = np.unique(row, return_inverse=True)
        at = part[hit]
        owner = np.concatenate([np.repeat(np.arange(len(hit)), self.k), row])
        similarity, ids = np.concatenate([self.best[at].reshape(-1), found]), np.concatenate([self.other[at].reshape(-1), other])
        order = np.lexsort((ids, -np.round(similarity, 12), owner))
        first = order[np.searchsorted(owner[order], np.arange(len(hit)))[:, None] + np.arange(self.k)]
        self.best[at], self.other[at] = similarity[first], ids[first]

    def found(self, last=None):
        """The best, after a ``last`` block of vectors."""
        if last is not None:
            self.meet(*last)
        if self.ids is None:
            return
        self._flush()
        step = max(1, 100_000 // self.k)
        for i in range(0, len(self.ids), step):
            best = self.best[i : i + step]
            row, column = np.nonzero(best >= self.least)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i : i + step][row]), pa.array(self.other[i : i + step][row, column]), pa.array(best[row, column])], names=["i", "j", "similarity"])


def best(rows: DataFrame, k: int, least: float | None, skip_self: bool, shared=None) -> DataFrame:
    """(i, j, similarity): the k best of each query in each part of the vectors, from ``dealt`` rows; ``shared`` holds the centres that cells mean."""

    def run(batches):
        at, held, first = None, None, None
        for batch in batches:
            for pair, side, ids, matrix, reach, cell, low, high in zip(*(batch[c] for c in ("pair", "side", "ids", "matrix", "reach", "cell", "low", "high")), strict=True):
                if held is None or pair.as_py() != at:
                    if held is not None:
                        yield from held.found(first)
                    at, held, first = pair.as_py(), _Part(k, least, skip_self, None if shared is None else shared.value), None
                numbers = np.frombuffer(ids.as_buffer(), np.int64).copy()
                values = np.frombuffer(matrix.as_buffer()).reshape(len(numbers), -1).copy()
                if side.as_py() == 0:
                    held.ask(numbers, values, np.frombuffer(reach.as_buffer()).copy() if reach.is_valid else None)
                else:
                    # Queries may still come until the next block of vectors does.
                    if first is not None:
                        held.meet(*first)
                    first = numbers, values, cell.as_py(), low.as_py(), high.as_py()
        if held is not None:
            yield from held.found(first)

    return rows.mapInArrow(run, FOUND)
