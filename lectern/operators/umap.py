"""Layouts that keep neighbourhoods (UMAP: McInnes, Healy, Melville 2018), over a table of neighbours.

*Weights*: each vector's k nearest get exp(-(d - rho) / sigma), rho the distance of the nearest that isn't at 0, sigma such that the
weights sum to log2(k); the two directions of a pair join as a + b - ab.

*Start*: the leading eigenvectors of the normalised graph, by power iteration: a round is one join of the edges with the vectors so
far, and a Gram matrix of a few numbers that the driver sees.

*Epochs*: attraction along edges, drawn by their weight, and repulsion from sampled points.  Points are dealt into blocks; a round gives each
block its edges, which are packed once, the far ends' places, each once, and a pool of points from everywhere to repel; the block then does some epochs on its
own points, and rounds go on from a written table.  A block holds its points times k edges and the pool, at any size of the corpus.

Draws depend on seed, round and block alone, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize, scratch, shared_dir
from . import maps
from .neighbours import neighbours_for, top_k

#: Vectors from which on there is a neighbourhood to keep; fewer are laid out by PCA.
LEAST_ROWS = 20
MIN_DIST, SEED = 0.05, 42
POWER_ROUNDS, ROUNDS, EPOCHS = 6, 8, 25
#: Points of a block, points of its pool, negative samples for each positive one.
BLOCK_POINTS, POOL, NEGATIVE = 4096, 1024, 5


def curve(min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a * d ** (2 b)), nearest to 1 up to ``min_dist`` and exp(min_dist - d) from there."""
    d = np.linspace(0, 3, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist)))
    a, b = 1.5, 0.9
    for _ in range(100):  # Gauss-Newton on (ln a, b)
        t = a * d ** (2 * b)
        f = 1 / (1 + t)
        slope = np.stack([-t * f**2, -2 * np.log(d) * t * f**2], axis=1)
        step = np.linalg.lstsq(slope, want - f, rcond=None)[0]
        a, b = a * np.exp(np.clip(step[0], -0.5, 0.5)), max(0.1, b + np.clip(step[1], -0.2, 0.2))
    return float(a), float(b)


def memberships(away: np.ndarray) -> np.ndarray:
    """Weights of each row's distances (ascending, inf where a row has fewer)."""
    real = np.isfinite(away)
    near = np.where(real & (away > 0), away, np.inf).min(axis=1)
    rho = np.where(np.isfinite(near), near, 0)[:, None]
    over = np.where(real, np.maximum(away - rho, 0), np.inf)
    target = np.log2(np.maximum(real.sum(axis=1), 2))
    low, high = np.zeros(len(away)), np.full(len(away), np.inf)
    sigma = np.ones(len(away))
    for _ in range(64):
        total = np.exp(-over / sigma[:, None]).sum(axis=1)
        above = total > target
        high, low = np.where(above, sigma, high), np.where(above, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
    mean = np.where(real, away, 0).sum(axis=1) / np.maximum(real.sum(axis=1), 1)
    return np.exp(-over / np.maximum(sigma, np.maximum(1e-3 * mean, 1e-12))[:, None])


def directed_weights(near: DataFrame) -> DataFrame:
    """(a, b, w) from (i, j, similarity): at most k rows of each i, one i in one row."""
    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct(F.greatest(1 - F.col("similarity"), F.lit(0.0)).alias("d"), "j"))).alias("x"))

    def run(batches):
        for batch in batches:
            rows = batch.column(1)
            sizes = np.diff(rows.offsets.to_numpy()).astype(np.int64)
            inner = rows.flatten()
            own = np.repeat(np.arange(len(batch)), sizes)
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            away = np.full((len(batch), max(sizes, default=1)), np.inf)
            away[own, place] = inner.field("d").to_numpy()
            weights = memberships(away)[own, place] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[own]), pa.array(inner.field("j").to_numpy()), pa.array(weights)], names=["a", "b", "w"])

    return lists.select("i", "x.d", "x.j").select("i", F.arrays_zip("d", "j").alias("x")).mapInArrow(run, "a long, b long, w double")


def fuzzy_edges(near: DataFrame) -> DataFrame:
    """(a, b, w) for every chosen neighbour b of a, with the weight that both directions agree on."""
    w = materialize(directed_weights(near), "umap-weights")  # read twice
    pair = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    joint = w.groupBy(*pair).agg(F.sum("w").alias("s"), F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(F.lit(0.0)).alias("p"))
    return w.select("a", "b", *pair).join(joint, ["low", "high"]).select("a", "b", (F.col("s") - F.col("p")).alias("w"))


def _sums(axes: int):
    """Of a partition's rows (id, q, p): the sums of q * q, of q times each axis, and of the axes' products, one after another."""

    def run(batches):
        total = np.zeros(1 + axes + axes * axes)
        for batch in batches:
            q, p = batch["q"].to_numpy(), batch["p"].flatten().to_numpy().reshape(-1, axes)
            total += np.concatenate([[q @ q], q @ p, (p.T @ p).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _turned(along: np.ndarray, turned: np.ndarray):
    """Rows (id, q, p) with ``along`` times q taken off p, and p turned."""

    def run(batches):
        axes = len(along)
        for batch in batches:
            p = batch["p"].flatten().to_numpy().reshape(-1, axes)
            fresh = (p - batch["q"].to_numpy()[:, None] * along) @ turned
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * axes, pa.int32()), pa.array(fresh.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["q"], places], names=["id", "q", "p"])

    return run


def _start(edges: DataFrame, first: DataFrame, axes: int, rounds: int) -> DataFrame:
    """(id, p): leading eigenvectors of the graph after the trivial one, from ``first``'s places, ten wide."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))
    state = materialize(first.join(degree, "id").select("id", F.sqrt("degree").alias("q"), "p"), "umap-state")
    links = both.join(state.select(F.col("id").alias("a"), F.col("q").alias("qa")), "a").join(state.select(F.col("id").alias("b"), F.col("q").alias("qb")), "b")
    links = materialize(links.select("a", "b", (F.col("w") / F.col("qa") / F.col("qb")).alias("m")), "umap-links")
    column = lambda k: F.col("p")[k]
    for turn in range(rounds + 1):
        # Without the trivial part, and orthonormal: both need sums of a few numbers.
        sums = sum(np.array(r["sums"]) for r in state.mapInArrow(_sums(axes), "sums array<double>").collect())  # a row for each partition
        qq, along, gram = sums[0], sums[1 : axes + 1] / sums[0], sums[axes + 1 :].reshape(axes, axes)
        gram = gram - np.outer(along, along) * qq
        turned = np.linalg.inv(np.linalg.cholesky(gram + np.eye(axes) * 1e-12 * max(np.trace(gram), 1e-12))).T
        state = state.mapInArrow(_turned(along, turned), state.schema)
        if turn == rounds:
            break
        pulled = links.join(state.select(F.col("id").alias("b"), "p"), "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("m") * column(k)).alias(f"y{k}") for k in range(axes)])
        state = materialize(state.join(pulled, "id").select("id", "q", F.array(*[(column(k) + F.col(f"y{k}")) / 2 for k in range(axes)]).alias("p")), "umap-state")
    placed = state.select("id", F.transform("p", lambda x: x / F.col("q")).alias("p"))
    spread = placed.agg(F.max(F.aggregate(F.transform("p", F.abs), F.lit(0.0), lambda s, x: F.greatest(s, x)))).first()[0] or 1.0
    jitter = F.transform(F.sequence(F.lit(1), F.lit(axes)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(1 << 20)) / (1 << 20) - 0.5) * 2e-3)
    return placed.select("id", F.zip_with(F.transform("p", lambda x: x * (10.0 / spread)), jitter, lambda x, y: F.round(x + y, 6)).alias("p"))  # sums in another order differ by far less


def _squares(d: list[np.ndarray]) -> np.ndarray:
    """Squared lengths of vectors that are given by axes, added up in the order in which numpy sums a row."""
    s = [x * x for x in d]
    first = reduce(np.add, s[:8]) if len(s) < 8 else ((s[0] + s[1]) + (s[2] + s[3])) + ((s[4] + s[5]) + (s[6] + s[7]))
    return reduce(np.add, s[8:], first)


def _clipped(pull: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = pull * d
    np.maximum(x, -4, out=x)
    return np.minimum(x, 4, out=x)


def _epochs(axes: int, a: float, b: float, seed: int, turn: int, rounds: int, epochs: int):
    """A block's points after some epochs.  Rows: points (kind 0), its edges' far ends in other blocks (1), the pool (2), its packed edges (3, no place)."""

    def run(table: pa.Table) -> pa.Table:
        kept = table.filter(pc.equal(table["kind"], 3))
        start, other, weight = (np.frombuffer(b"".join(kept[c].to_pylist()), kind) for c, kind in (("a", np.int64), ("b", np.int64), ("w", np.float64)))
        first = table["block"][0].as_py()
        table = table.select(["kind", "id", "p"]).filter(pc.less(table["kind"], 3)).sort_by([("kind", "ascending"), ("id", "ascending")])
        kind = table["kind"].to_numpy()
        places = table["p"].combine_chunks().flatten().to_numpy().reshape(-1, axes)
        ids = table["id"].to_numpy()
        own, pool = ids[kind == 0], places[kind == 2].T.copy()
        at = places[kind == 0].T.copy()  # an axis after another
        source = np.searchsorted(own, start)
        target = np.minimum(np.searchsorted(own, other), len(own) - 1)
        inside = own[target] == other
        near = np.searchsorted(known := np.concatenate([own, ids[kind == 1]]), other, sorter=(order := np.argsort(known)))
        far = np.concatenate([places[kind == 0], places[kind == 1]])[order[near]].T.copy()
        chance = weight / max(weight.max(), 1e-300) if len(weight) else weight
        rng = np.random.default_rng([seed, turn, int(first) & 0x7FFFFFFF])
        for epoch in range(epochs):
            rate = 1 - (turn * epochs + epoch) / (rounds * epochs)
            drawn = rng.permutation(np.flatnonzero(rng.random(len(chance)) < chance))
            for part in np.array_split(drawn, 8):
                if not len(part):
                    continue
                i, here = source[part], inside[part]
                end = target[part]
                mine = [x[i] for x in at]
                d = [x - np.where(here, y[end], z[part]) for x, y, z in zip(mine, at, far, strict=True)]
                square = _squares(d)
                pull = np.where(square > 0, -2 * a * b * np.maximum(square, 1e-12) ** (b - 1) / (1 + a * square**b), 0)
                move = [_clipped(pull, x) for x in d]
                for _ in range(NEGATIVE):
                    other = rng.integers(0, pool.shape[1], len(i))
                    d = [x - y[other] for x, y in zip(mine, pool, strict=True)]
                    square = _squares(d)
                    push = 2 * b / ((1e-3 + square) * (1 + a * square**b))
                    for x, y in zip(move, d, strict=True):
                        x += _clipped(push, y)  # nothing where both are one place: there y is 0
                for x, y in zip(at, move, strict=True):
                    x += rate * np.bincount(i, y, len(own))
        at = at.T
        return pa.table({"id": pa.array(own), "p": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * axes, pa.int32()), pa.array(at.reshape(-1)))})

    return run


def _optimised(edges: DataFrame, start: DataFrame, n: int, axes: int, min_dist: float, seed: int, rounds: int, epochs: int) -> DataFrame:
    a, b = curve(min_dist)
    blocks = max(1, -(-n // BLOCK_POINTS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    state = start
    none = F.lit(None)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64())} | {c: pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in ("a", "b", "w")})

    # Edges are packed once, and a round only sends places: a point's to each of the other blocks whose edges end there, once.
    of = lambda end: F.pmod(F.xxhash64(end), F.lit(blocks))
    kept = materialize(edges.select(of("a").alias("block"), "a", "b", "w").repartition(blocks, "block").groupBy("block").applyInArrow(pack, "block long, a binary, b binary, w binary"), "umap-packed")
    kept = kept.select("block", F.lit(3).alias("kind"), none.cast("long").alias("id"), none.cast("array<double>").alias("p"), "a", "b", "w")
    asked = edges.select(F.col("b").alias("id"), of("a").alias("to")).where(F.col("to") != of("id")).groupBy("id").agg(F.collect_set("to").alias("to"))
    asked = materialize(asked, "umap-asked")
    packed = [none.cast("binary").alias(c) for c in "abw"]
    for turn in range(rounds):
        points = state.select(block.alias("block"), F.lit(0).alias("kind"), "id", "p", *packed)
        far = state.join(asked, "id").select(F.explode("to").alias("block"), F.lit(1).alias("kind"), "id", "p", *packed)
        # A point goes to one block's pool at most: a quarter of all to some block, all of them where there is one block.
        draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        pool = state.where(draw < POOL / BLOCK_POINTS) if blocks > 1 else state
        pool = pool.select(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(blocks)).alias("block"), F.lit(2).alias("kind"), "id", "p", *packed)
        rows = points.unionByName(far).unionByName(pool).unionByName(kept).repartition(blocks, "block")
        state = materialize(rows.groupBy("block").applyInArrow(_epochs(axes, a, b, seed, turn, rounds, epochs), "id long, p array<double>"), "umap-places")
    return state


def layout(vectors: DataFrame, axes: int = 3, min_dist: float = MIN_DIST, k: int | None = None, seed: int = SEED, rounds: int = ROUNDS, epochs: int = EPOCHS) -> DataFrame:
    """(id, p): places of all vectors on ``axes`` axes; ``vectors`` has id (distinct) and v.

    Fewer than LEAST_ROWS vectors are laid out by PCA.  Vectors without a neighbour at all stay where PCA has them.  Tables of the rounds are
    written to the shared folder and removed.
    """
    spark = vectors.sparkSession
    shared_dir(spark)  # asked for at any size
    n = vectors.count()
    with scratch(spark) as keep:
        rows = materialize(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "umap-vectors")
        dim = len((rows.first() or {"v": [0.0]})["v"]) if n else 1
        if n == 0:
            return vectors.select(F.col("id").cast("long").alias("id"), F.array().cast("array<double>").alias("p"))
        mean, components = maps.fit_pca(rows, dim, axes)
        moved = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
        first = rows.withColumn("_v", moved).select("id", F.array(*[F.aggregate(F.zip_with("_v", F.lit(components[:, c].tolist()), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for c in range(axes)]).alias("p"))
        if n < LEAST_ROWS:
            return keep(first, "umap-layout")
        first = materialize(first, "umap-first")
        near = top_k(rows, rows, min(k or neighbours_for(n), n - 1))
        edges = materialize(fuzzy_edges(near), "umap-edges")
        start = materialize(_start(edges, first, axes, POWER_ROUNDS), "umap-start")
        placed = _optimised(edges, start, n, axes, min_dist, seed, rounds, epochs)
        lost = first.join(placed.select("id"), "id", "left_anti")
        return keep(placed.unionByName(lost), "umap-layout")


def place(points: DataFrame, fitted: DataFrame, places: DataFrame, k: int | None = None) -> DataFrame:
    """(id, p) of vectors that weren't fitted: the mean of their nearest fitted vectors' places, by membership weight; others stay where they are."""
    n = fitted.count()
    near = top_k(points, fitted, min(k or neighbours_for(n), n), skip_self=False)
    axes = len(places.first()["p"])
    weights = directed_weights(near).join(places.select(F.col("id").alias("b"), "p"), "b")
    sums = weights.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("p")[c]).alias(f"s{c}") for c in range(axes)])
    return sums.select("id", F.array(*[F.col(f"s{c}") / F.col("w") for c in range(axes)]).alias("p"))
