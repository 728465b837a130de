"""Density clustering of document vectors: scale rules, HDBSCAN, choosing the smallest cluster.

HDBSCAN (Campello, Moulavi, Sander 2013; McInnes, Healy 2017) needs a minimum spanning tree by mutual
reachability.  Up to DENSITY_ROWS vectors one task builds it (Prim); beyond, parts of the vectors are compared in a grid for
core distances, and then for the least edge out of every component but the largest, round by round (Boruvka), for all numbers of samples at once.  Edges are ordered
by weight and ends, so there is one tree for each number and both ways give the same rows.  What follows the tree is ``clusters_of`` in one task, and tables
(``condensing``) beyond.

Vectors lie in blocks with their neighbours, and points pass by leaves out of their reach; where nothing is out of reach, comparing stays
quadratic.  K-means in MLlib stands beside it for whoever asks for it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graphs import connected_components
from ..functions.tables import scratch, settled, shared_dir
from ..functions.vectors import unit
from . import condensing

MIN_ROWS, SMALLEST, PARTS = 30, 3, 10
#: Vectors up to which one task builds the tree, and vectors of a block beyond.
DENSITY_ROWS, BLOCK_ROWS = 5000, 2048
#: Vectors that one task asks for at most, and those of them that are compared at once with a leaf of so many.
ASKING_ROWS, HIGH, LEAF_ROWS = 1 << 16, 512, 256
#: Cells that vectors are dealt to at most (a power of two), and vectors that the cuts of each are read off.
CELLS, CUT_BY = 1 << 10, 64
NONE = np.iinfo(np.int64).max


def floor_candidates(rows: int) -> list[int]:
    """Smallest cluster sizes to try: from 3 to twice the root of the rows, eight at most, evenly spaced."""
    top = max(SMALLEST + 1, round(2.0 * math.sqrt(rows)))
    span = range(SMALLEST, top + 1)
    if len(span) <= 8:
        return list(span)
    return sorted({span[round(k * (len(span) - 1) / 7)] for k in range(8)})


def min_samples_for(rows: int, floor: int) -> int:
    return 1 if rows < 200 else max(1, min(floor, round(math.sqrt(floor))))


def max_cluster_share(rows: int) -> float:
    return 0.5 if rows < 200 else 0.6 if rows < 1000 else 0.7


def dominant_share(labels: np.ndarray) -> float:
    found = labels[labels >= 0]
    return float(np.bincount(found).max() / len(labels)) if len(found) else 1.0


def spanning_tree(points: np.ndarray, samples: int) -> np.ndarray:
    """Edges (a, b, weight), a below b, of the minimum spanning tree by mutual reachability, lightest first (Prim)."""
    n = len(points)
    core = np.array([np.partition(distances(points[i : i + 1], points)[0], min(samples, n - 1))[min(samples, n - 1)] for i in range(n)])
    index = np.arange(n)
    best, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    outside = np.ones(n, bool)
    here, edges = 0, []
    outside[0] = False
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(distances(points[here : here + 1], points)[0], core), core[here])
        a, b = np.minimum(index, here), np.maximum(index, here)
        closer = outside & ((reach < best) | ((reach == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = reach[closer], a[closer], b[closer]
        least = np.where(outside, best, np.inf)
        ties = np.flatnonzero(least == least.min())
        here = int(ties[np.lexsort((high[ties], low[ties]))[0]])
        edges.append((low[here], high[here], best[here]))
        outside[here] = False
    return sorted_tree(np.array(edges, float).reshape(-1, 3))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of two matrices, summed axis by axis: the same numbers whatever the blocks are."""
    square = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        square += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(square)


def sorted_tree(tree: np.ndarray) -> np.ndarray:
    return tree[np.lexsort((tree[:, 1], tree[:, 0], tree[:, 2]))]


def condensed_tree(tree: np.ndarray, n: int, floor: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, density, size): clusters (ids from n on) that lose points or split in two of at least ``floor``."""
    parent = list(range(2 * n - 1))
    size, left, right, height = [1] * n + [0] * (n - 1), [0] * (2 * n - 1), [0] * (2 * n - 1), [0.0] * (2 * n - 1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (a, b, w) in enumerate(tree):
        x, y, made = root(int(a)), root(int(b)), n + k
        parent[x] = parent[y] = made
        left[made], right[made], size[made], height[made] = x, y, size[x] + size[y], w

    def leaves(x: int) -> list[int]:
        stack, found = [x], []
        while stack:
            y = stack.pop()
            found.append(y) if y < n else stack.extend((left[y], right[y]))
        return found

    rows, fresh, stack = [], n + 1, [(2 * n - 2, n)]
    while stack:
        node, label = stack.pop()
        if node < n:
            continue
        density = 1 / height[node] if height[node] > 0 else np.inf
        sides = (left[node], right[node])
        big = [s for s in sides if size[s] >= floor]
        if len(big) == 2:
            for s in sides:
                rows.append((label, fresh, density, size[s]))
                stack.append((s, fresh))
                fresh += 1
        else:
            for s in sides:
                if size[s] >= floor:
                    stack.append((s, label))
                else:
                    rows += [(label, p, density, 1) for p in leaves(s)]
    return rows


def hdbscan(points: np.ndarray, floor: int, samples: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels (-1: noise), strengths and relative validity, by excess of mass."""
    return clusters_of(spanning_tree(points, samples), len(points), floor)


def clusters_of(tree: np.ndarray, n: int, floor: int) -> tuple[np.ndarray, np.ndarray, float]:
    """As hdbscan, from the tree."""
    rows = condensed_tree(tree, n, floor)
    born = {n: 0.0} | {c: d for _, c, d, s in rows if c >= n}
    stability = dict.fromkeys(born, 0.0)
    for p, _, d, s in rows:
        stability[p] += (min(d, 1e12) - born[p]) * s
    below: dict[int, list[int]] = {c: [] for c in born}
    for p, c, _, _ in rows:
        if c >= n:
            below[p].append(c)
    chosen: dict[int, bool] = {}
    for c in sorted(born, reverse=True):
        inner = sum(stability[k] for k in below[c])
        chosen[c] = c != n and (not below[c] or stability[c] >= inner)
        if not chosen[c]:
            stability[c] = inner if c != n else stability[c]
    for c in sorted(born):
        if chosen[c]:
            stack = list(below[c])
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack += below[k]
    up = {c: p for p, c, _, _ in rows if c >= n}
    labels, strength = np.full(n, -1), np.zeros(n)
    number: dict[int, int] = {}
    left_at = np.zeros(n)
    owner: dict[int, int] = {}
    top: dict[int, int] = {}
    for c in sorted(born):  # a cluster's number is above its parent's
        top[c] = c if chosen[c] else top.get(up.get(c, -1), -1)
    for p, c, d, _ in rows:
        if c < n and top[p] >= 0:
            owner[c], left_at[c] = top[p], min(d, 1e12)
    for c in sorted(owner):  # clusters are numbered by their least point
        labels[c] = number.setdefault(owner[c], len(number))
    most, own = np.zeros(len(number)), labels >= 0
    np.maximum.at(most, labels[own], left_at[own])
    reach = most[labels[own]]
    strength[own] = np.where(reach > 0, left_at[own] / np.where(reach > 0, reach, 1.0), 1.0)
    return labels, strength, relative_validity(tree, labels)


def relative_validity(tree: np.ndarray, labels: np.ndarray) -> float:
    """Separation against sparseness of clusters, both read off the spanning tree; -1 to 1."""
    count = labels.max() + 1 if len(labels) else 0
    if count < 2:
        return -1.0
    inner, outer = np.zeros(count), np.full(count, np.inf)
    a, b = labels[tree[:, 0].astype(int)], labels[tree[:, 1].astype(int)]
    for x, y, w in zip(a, b, tree[:, 2], strict=True):
        if x == y and x >= 0:
            inner[x] = max(inner[x], w)
        else:
            for side in (x, y):
                if side >= 0:
                    outer[side] = min(outer[side], w)
    share = np.bincount(labels[labels >= 0], minlength=count) / len(labels)
    outer = np.where(np.isinf(outer), inner, outer)
    top = np.maximum(np.maximum(inner, outer), 1e-300)
    return float((share * (outer - inner) / top).sum())


def choose_floor(trees: dict[int, np.ndarray], n: int) -> int:
    """The smallest cluster size of best validity whose largest cluster isn't too large; else the best of all; else 3.  Trees are by samples."""
    fits, others = [], []
    for floor in floor_candidates(n):
        labels, _, validity = clusters_of(trees[min_samples_for(n, floor)], n, floor)
        if labels.max() >= 1:
            (fits if dominant_share(labels) <= max_cluster_share(n) else others).append((validity, -floor))
    best = max(fits or others, default=(0, -SMALLEST))
    return -best[1]


def _samples(n: int, floor: int | None) -> list[int]:
    """How many samples trees are needed for."""
    floors = floor_candidates(n) if floor is None else []
    limit = lambda f: max(2, min(f, n // 4))
    return sorted({min_samples_for(n, f) for f in floors} | {min_samples_for(n, limit(f)) for f in [*floors, SMALLEST, *([floor] if floor else [])]})


def _labels(trees: dict[int, np.ndarray], ids: np.ndarray, floor: int | None) -> pd.DataFrame:
    n = len(ids)
    size = choose_floor(trees, n) if floor is None else floor
    size = max(2, min(size, n // 4))
    labels, strength, _ = clusters_of(trees[min_samples_for(n, size)], n, size)
    return pd.DataFrame({"id": ids, "cluster": labels, "strength": strength})


def reduced(vectors: DataFrame, by: str = "pca") -> DataFrame:
    """(id, p): unit vectors on their leading components, or laid out on as many axes by their neighbourhoods (``by`` "umap")."""
    from . import maps, umap

    if by == "umap":
        return umap.layout(vectors, axes=PARTS, min_dist=0.0)
    units = vectors.select("id", unit(F.col("v")).alias("v"))
    first = units.first()
    mean, components = maps.fit_pca(units, len(first["v"]), min(PARTS, len(first["v"])))
    moved = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
    axes = [F.aggregate(F.zip_with("_v", F.lit(components[:, k].tolist()), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for k in range(components.shape[1])]
    return units.withColumn("_v", moved).select("id", F.array(*axes).alias("p"))


def cluster_vectors(vectors: DataFrame, floor: int | None = None, by: str = "pca") -> DataFrame:
    """(id, cluster, strength): fewer than 30 vectors are all noise.

    Density is that of the ``reduced`` vectors.  The shared folder is asked for at any size, though few vectors write nothing there; tables go when
    the result is written.
    """
    shared_dir(vectors.sparkSession)
    n = vectors.count()
    if n < MIN_ROWS:
        return vectors.select(F.col("id").cast("long").alias("id"), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("strength"))
    points = reduced(vectors, by)
    if n > DENSITY_ROWS:
        with scratch(vectors.sparkSession) as keep:
            return keep(_cluster_by_blocks(points, n, floor), "clusters")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        matrix = np.stack(rows["p"].to_numpy())
        return _labels({s: spanning_tree(matrix, s) for s in _samples(n, floor)}, rows["id"].to_numpy(), floor)

    return points.withColumn("corpus", F.lit(0)).groupBy("corpus").applyInPandas(run, "id long, cluster long, strength double")  # DENSITY_ROWS at most


def _cluster_by_blocks(points: DataFrame, n: int, floor: int | None) -> DataFrame:
    """As the one task's, where parts are compared in many."""
    spark = points.sparkSession
    blocks = -(-n // BLOCK_ROWS)
    # Places 0 to n - 1 in the order of ids, as one task has them: counts of ranges first, then places inside.
    ranged = settled(points.repartitionByRange(blocks, "id").sortWithinPartitions("id").withColumn("range", F.spark_partition_id()))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # one row per block
    before, total = {}, 0
    for r in sorted(counts):
        before[r], total = total, total + counts[r]
    offsets = spark.createDataFrame(list(before.items()), "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    placed = settled(ranged.withColumn("inside", inside).join(F.broadcast(offsets), "range").select((F.col("before") + F.col("inside")).alias("place"), "id", "p"))
    samples = _samples(n, floor)
    edges = _trees_by_blocks(placed, n, samples, blocks)

    floors = {min(max(2, f), max(2, n // 4)) for f in ([floor] if floor is not None else [])} or None
    tried = sorted(floors) if floors else floor_candidates(n)
    if n - 1 <= condensing.CHUNK:
        return _named(placed, _labels_by_floor(edges, n, tried, choose=floors is None))
    nodes = reduce(DataFrame.unionByName, [condensing.merges(edges.where(F.col("tree") == s), n).withColumn("tree", F.lit(s)) for s in samples])

    def found_for(sizes: list[int]) -> tuple[DataFrame, DataFrame]:
        keys = spark.createDataFrame([(f, min_samples_for(n, f), f, n) for f in sizes], "key long, tree int, floor long, n long")
        clusters, points = condensing.condensed(nodes, keys)
        return keys, settled(condensing.members(points, condensing.chosen(clusters, points)))

    if floors is None:
        keys, found = found_for(tried)
        fits, others = [], []
        for r in condensing.validities(edges, keys, found).collect():  # a row for each floor, eight at most
            if r["clusters"] >= 2:
                (fits if r["share"] <= max_cluster_share(n) else others).append((r["validity"], -r["key"]))
        size = -max(fits or others, default=(0, -SMALLEST))[1]
        size = max(2, min(size, n // 4))
        found = found.where(F.col("key") == size) if size in tried else found_for([size])[1]
    else:
        found = found_for(tried)[1]
    return _named(placed, condensing.labelled(found))


def _named(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, cluster, strength) of all vectors, from those in clusters (point, cluster, strength)."""
    out = placed.select(F.col("place").alias("point"), "id").join(found, "point", "left")
    return out.select(F.col("id").cast("long").alias("id"), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _labels_by_floor(edges: DataFrame, n: int, floors: list[int], choose: bool) -> DataFrame:
    """(point, cluster, strength) from trees of at most condensing.CHUNK edges each: a task for each smallest cluster size, eight at most."""
    spark = edges.sparkSession

    def made(sizes: list[int]) -> DataFrame:
        keys = spark.createDataFrame([(f, min_samples_for(n, f), k) for k, f in enumerate(sizes)], "floor long, tree int, part int")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            floor = int(rows["floor"].iloc[0])
            labels, strength, validity = clusters_of(sorted_tree(rows[["a", "b", "w"]].to_numpy(float)), n, floor)
            own = np.flatnonzero(labels >= 0)
            # A row without a point says how good the clusters are: their number, the largest one's share, validity.
            told = pd.DataFrame({"point": [-1], "cluster": [labels.max() + 1], "strength": [validity], "share": [dominant_share(labels)]})
            return pd.concat([pd.DataFrame({"point": own, "cluster": labels[own], "strength": strength[own], "share": 0.0}), told]).assign(floor=floor)

        dealt = edges.join(F.broadcast(keys), "tree").repartitionById(len(sizes), F.col("part"))
        return settled(dealt.groupBy("part", "floor").applyInPandas(run, "point long, cluster long, strength double, share double, floor long"))

    found, size = made(floors), floors[0]
    if choose:
        fits, others = [], []
        for r in found.where("point < 0").collect():  # a row for each floor
            if r["cluster"] >= 2:
                (fits if r["share"] <= max_cluster_share(n) else others).append((r["strength"], -r["floor"]))
        size = -max(fits or others, default=(0, -SMALLEST))[1]
        size = max(2, min(size, n // 4))
        found = found if size in floors else made([size])
    return found.where((F.col("floor") == size) & (F.col("point") >= 0)).select("point", "cluster", "strength")


def _order(matrix: np.ndarray, rows: int) -> np.ndarray:
    """The rows of a matrix in an order in which each stretch of ``rows`` lies close together: halved again and again along the axis of most variance."""
    order, stack = np.arange(len(matrix)), [(0, len(matrix))]
    while stack:
        a, b = stack.pop()
        parts = -(-(b - a) // rows)
        if parts > 1:
            own, middle = matrix[order[a:b]], (parts + 1) // 2 * rows
            order[a:b] = order[a:b][np.argpartition(own[:, own.var(axis=0).argmax()], middle)]
            stack += [(a, a + middle), (a + middle, b)]
    return order


def _cuts(matrix: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of each cut of a tree of halves (the children of i are 2 i + 1 and 2 i + 2)."""
    axes, cuts, held = [], [], [matrix]
    for node in range((1 << depth) - 1):
        own = held[node]
        axis = int(own.var(axis=0).argmax()) if len(own) else 0
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        axes.append(axis)
        cuts.append(cut)
        held += [own[own[:, axis] <= cut], own[own[:, axis] > cut]]
    return np.array(axes, int), np.array(cuts)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The numbers of a column of lists of one length, a row each."""
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _in_blocks(placed: DataFrame, n: int, blocks: int) -> tuple[DataFrame, int]:
    """(block, slot, place, p), and the number of blocks: each holds vectors that lie close together, BLOCK_ROWS at most, leaves in a row.

    Cells come first, whose cuts a bounded number of vectors tells; a cell with too many (copies can't be cut) is dealt out by place.  Where vectors
    stand changes what is compared, not what is found.
    """
    depth = min(CELLS.bit_length() - 1, max(0, blocks.bit_length() - 1))
    few = placed.where(F.pmod(F.xxhash64("place"), F.lit(max(1, n // (CUT_BY << depth)))) == 0).select("p")
    axes, cuts = _cuts(_flat(few.toArrow(), "p") if depth else np.zeros((0, 1)), depth)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                matrix, at = _flat(table, "p"), np.zeros(batch.num_rows, np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (matrix[np.arange(len(at)), axes[at]] > cuts[at])
                yield from table.append_column("cell", pa.array(at - len(axes))).to_batches()

    dealt = settled(placed.select("place", "p").mapInArrow(deal, "place long, p array<double>, cell long"))
    sizes = dealt.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / ASKING_ROWS)).drop("count")
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")))
    first, blocks = [], 0
    for r in dealt.groupBy("cell", "part").count().orderBy("cell", "part").collect():  # a row for each cell, or 65,536 vectors of it
        first.append((r["cell"], r["part"], blocks))
        blocks += -(-r["count"] // BLOCK_ROWS)

    def order(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        table = table.take(pa.array(_order(_flat(table, "p"), min(LEAF_ROWS, BLOCK_ROWS))))
        at = np.arange(table.num_rows)
        return pa.table({"block": pa.array(table["first"].to_numpy() + at // BLOCK_ROWS), "slot": pa.array(at % BLOCK_ROWS), "place": table["place"], "p": table["p"]})

    numbered = dealt.join(F.broadcast(placed.sparkSession.createDataFrame(first, "cell long, part long, first long")), ["cell", "part"])
    return settled(numbered.select("first", "place", "p").groupBy("first").applyInArrow(order, "block long, slot long, place long, p array<double>")), blocks


def _grid(packed: DataFrame, blocks: int) -> DataFrame:
    """Every part of the blocks, as those that ask (side 0, first; neighbours together), with every part of them as those that answer."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    asking = max(1, min(blocks, max(cores, -(-blocks * BLOCK_ROWS // ASKING_ROWS))))
    answering = max(1, min(blocks, -(-2 * cores // asking)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = packed.withColumn("other", every(answering)).withColumn("pair", F.floor(F.col("block") * asking / blocks) * answering + F.col("other"))
    b = packed.withColumn("other", every(asking)).withColumn("pair", F.col("other") * answering + F.pmod("block", F.lit(answering)))
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).drop("block", "other")
    return both.repartitionById(asking * answering, F.col("pair").cast("int")).sortWithinPartitions("pair", "side")


def _met(make):
    """Over rows of the grid: what ``make()`` finds for each pair of parts."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                if held is None or row["pair"] != at:
                    if held is not None:
                        yield from held.found()
                    at, held = row["pair"], make()
                places = np.frombuffer(row["places"], np.int64)
                matrix = np.asfortranarray(np.frombuffer(row["matrix"]).reshape(len(places), -1))
                more = [np.frombuffer(row[c], kind).reshape(-1, len(places)) for c, kind in (("cores", np.float64), ("keys", np.int64)) if c in row]
                (held.meet if row["side"] else held.ask)(places, matrix, *more)
        if held is not None:
            yield from held.found()

    return run


def _leaves(rows: int) -> list[slice]:
    size = min(LEAF_ROWS, BLOCK_ROWS)
    return [slice(i, min(i + size, rows)) for i in range(0, rows, size)]


def _reaching(at: np.ndarray, matrix: np.ndarray, limit: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of the points ``at``, those whose ``limit`` (below 0: of no use) reaches the box around the others.

    A gap is summed as ``distances`` are, so it is never above any of them.
    """
    low, high = other.min(axis=0), other.max(axis=0)
    gap = np.zeros(len(at))
    for k in range(matrix.shape[1]):
        x = matrix[at, k]
        gap += np.maximum(np.maximum(low[k] - x, x - high[k]), 0) ** 2
    far = limit[at]
    return at[(far >= 0) & (gap <= far**2 * (1 + 1e-12))]


def _within(matrix: np.ndarray, limit: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the pairs that a product of matrices, within what it may be off by, doesn't show to be too far."""
    own, lengths = (matrix**2).sum(axis=1), (other**2).sum(axis=1)
    off = 1e-12 * (own + lengths.max(initial=0))
    square = lengths - 2 * (matrix @ other.T)
    row, column = np.divmod(np.flatnonzero(square <= (limit**2 * (1 + 1e-12) - own + off)[:, None]), len(other))
    total = np.zeros(len(row))
    for axis in range(matrix.shape[1]):  # as ``distances``
        total += (matrix[row, axis] - other[column, axis]) ** 2
    return row, column, np.sqrt(total)


class _Near:
    """Points that ask, and how far the ``k`` nearest of each are, so far; itself is among them, at 0."""

    def __init__(self, k: int):
        self.k, self.asked, self.places = k, [], None

    def ask(self, *block) -> None:
        self.asked.append(block)

    def _begin(self) -> None:
        self.places, self.matrix = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        self.matrix = np.asfortranarray(self.matrix)
        self.best = np.full((len(self.places), self.k), np.inf)
        # The k-th of a point's own block is as far as any of its k can be.
        bounds = []
        for _, own in self.asked:
            for i in range(0, len(own), 64):
                away = distances(own[i : i + 64], own)
                bounds.append(np.partition(away, self.k - 1, axis=1)[:, self.k - 1] if self.k <= len(own) else np.full(len(away), np.inf))
        self.bound = np.concatenate(bounds)
        self.limit = self.bound.copy()

    def meet(self, _, other: np.ndarray) -> None:
        if self.places is None:
            self._begin()
        near = _reaching(np.arange(len(self.places)), self.matrix, self.limit, other)
        for leaf in _leaves(len(other)):
            at = _reaching(near, self.matrix, self.limit, other[leaf])
            for i in range(0, len(at), HIGH):
                mine = at[i : i + HIGH]
                row, _, away = _within(self.matrix[mine], self.limit[mine], other[leaf])
                hit = (away <= self.bound[mine[row]]) & (away < self.best[mine[row], self.k - 1])
                self._keep(mine, row[hit], away[hit])

    def _keep(self, mine: np.ndarray, row: np.ndarray, away: np.ndarray) -> None:
        if not len(row):
            return
        first = np.flatnonzero(np.diff(row, prepend=-1))
        count = np.diff(np.append(first, len(row)))
        x = mine[row[first]]
        more = np.full((len(x), count.max()), np.inf)
        more[np.repeat(np.arange(len(x)), count), np.arange(len(row)) - np.repeat(first, count)] = away
        self.best[x] = np.partition(np.concatenate([self.best[x], more], axis=1), self.k - 1, axis=1)[:, : self.k]
        self.limit[x] = np.minimum(self.bound[x], self.best[x, self.k - 1])

    def found(self):
        for i in range(0, 0 if self.places is None else len(self.places), 10_000):
            best = self.best[i : i + 10_000]
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * self.k, pa.int32()), pa.array(best.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(self.places[i : i + 10_000]), near], names=["place", "near"])


class _Out:
    """Points that ask, and the least edge of each out of its component, so far, in every tree that isn't whole.

    ``largest`` has the key of each such tree's largest component, whose points don't ask: the others join it by their own edges.
    Only the least edge of a component is looked for: a point looks no further than the least that a point of its component has found.
    """

    def __init__(self, largest: dict[int, int]):
        self.largest, self.asked, self.places = largest, [], None

    def ask(self, *block) -> None:
        self.asked.append(block)

    def _begin(self) -> None:
        places, matrix, cores, keys = (np.concatenate(x, axis=k) for x, k in zip(zip(*self.asked, strict=True), (0, 0, 1, 1), strict=True))
        asks = np.stack([keys[t] != key for t, key in self.largest.items()])
        some = asks.any(axis=0)
        self.places, self.matrix, self.cores, self.keys, self.asks = places[some], np.asfortranarray(matrix[some]), cores[:, some], keys[:, some], asks[:, some]
        shape = self.asks.shape
        self.best, self.low, self.high, self.other = np.full(shape, np.inf), *(np.full(shape, NONE) for _ in range(3))
        parts = [np.unique(self.keys[t], return_inverse=True) for t in self.largest]
        self.part, self.least = [x[1].reshape(-1) for x in parts], [np.full(len(x[0]), np.inf) for x in parts]
        # A point's own leaf and block first: what is near lets the rest be passed by.
        mine, begin = np.cumsum(some) - some, 0
        for to, other, own_cores, own_keys in self.asked:
            own = lambda leaf, begin=begin: mine[begin + leaf.start : begin + leaf.stop][some[begin + leaf.start : begin + leaf.stop]]
            for leaf in _leaves(len(to)):
                at = own(leaf)
                for i in range(0, len(at), HIGH):
                    self._all(at[i : i + HIGH], to[leaf], other[leaf], own_cores[:, leaf], own_keys[:, leaf])
            self._meet(own(slice(0, len(to))), to, other, own_cores, own_keys)
            begin += len(to)

    def meet(self, to: np.ndarray, other: np.ndarray, cores: np.ndarray, keys: np.ndarray) -> None:
        if self.places is None:
            self._begin()
        self._meet(np.arange(len(self.places)), to, other, cores, keys)

    def _meet(self, at: np.ndarray, to: np.ndarray, other: np.ndarray, cores: np.ndarray, keys: np.ndarray) -> None:
        limit = np.full(len(self.places), -np.inf)
        limit[at] = self._limit(at)
        near = _reaching(at, self.matrix, limit, other)
        for leaf in _leaves(len(to)):
            reached = _reaching(near, self.matrix, limit, other[leaf])
            for i in range(0, len(reached), HIGH):
                mine = reached[i : i + HIGH]
                far = self._limit(mine)
                some, none = np.isfinite(far), far == np.inf
                if none.any():
                    self._all(mine[none], to[leaf], other[leaf], cores[:, leaf], keys[:, leaf])
                if some.any():
                    self._near(mine[some], far[some], to[leaf], other[leaf], cores[:, leaf], keys[:, leaf])

    def _bound(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.least[k][self.part[k][at]]

    def _limit(self, at: np.ndarray) -> np.ndarray:
        """How far an edge may reach that is of use to a point's component, in whatever tree; none reaches less than the point's core."""
        out = np.full(len(at), -np.inf)
        for k, t in enumerate(self.largest):
            bound = self._bound(k, at)
            np.maximum(out, bound, out=out, where=self.asks[k, at] & (self.cores[t, at] <= bound))
        return out

    def _all(self, at: np.ndarray, to: np.ndarray, other: np.ndarray, cores: np.ndarray, keys: np.ndarray) -> None:
        away = distances(self.matrix[at], other)
        for k, t in enumerate(self.largest):
            asks = self.asks[k, at]
            mine = at[asks]
            if not len(mine):
                continue
            reach = np.maximum(away[asks], cores[t])
            np.copyto(reach, np.inf, where=self.keys[t, mine, None] == keys[t])
            least = np.maximum(reach.min(axis=1), self.cores[t, mine])
            hit = np.flatnonzero(np.isfinite(least) & (least <= self.best[k, mine]))
            if len(hit):
                self._keep(k, mine[hit], least[hit], reach[hit], to, keys[t])

    def _near(self, at: np.ndarray, limit: np.ndarray, to: np.ndarray, other: np.ndarray, cores: np.ndarray, keys: np.ndarray) -> None:
        """As _all, from the pairs alone that may be within the limit."""
        row, column, away = _within(self.matrix[at], limit, other)
        if not len(row):
            return
        mine = at[row]
        low, high = np.minimum(self.places[mine], to[column]), np.maximum(self.places[mine], to[column])
        for k, t in enumerate(self.largest):
            bound = self._bound(k, at)
            open_ = np.flatnonzero((self.asks[k, at] & (self.cores[t, at] <= bound))[row])
            if not len(open_):
                continue
            x, y = mine[open_], column[open_]
            reach = np.maximum(np.maximum(away[open_], cores[t, y]), self.cores[t, x])
            fit = (reach <= np.minimum(bound[row[open_]], self.best[k, x])) & (self.keys[t, x] != keys[t, y])
            hit, reach = open_[fit], reach[fit]
            if not len(hit):
                continue
            order = np.lexsort((high[hit], low[hit], reach, row[hit]))
            hit, reach = hit[order], reach[order]
            first = np.flatnonzero(np.diff(row[hit], prepend=-1))  # the least of each point
            hit, reach = hit[first], reach[first]
            x = mine[hit]
            tied = reach == self.best[k, x]
            better = ~tied | (low[hit] < self.low[k, x]) | ((low[hit] == self.low[k, x]) & (high[hit] < self.high[k, x]))
            hit, reach = hit[better], reach[better]
            x = mine[hit]
            self.best[k, x], self.low[k, x], self.high[k, x], self.other[k, x] = reach, low[hit], high[hit], keys[t, column[hit]]
            np.minimum.at(self.least[k], self.part[k][x], reach)

    def _keep(self, k: int, at: np.ndarray, least: np.ndarray, reach: np.ndarray, to: np.ndarray, keys: np.ndarray) -> None:
        """Of equally short edges the one with the lower lower end, then the lower upper end."""
        tied, own = reach <= least[:, None], self.places[at, None]
        low = np.where(tied, np.minimum(own, to), NONE)
        first = low.min(axis=1)
        high = np.where(tied & (low == first[:, None]), np.maximum(own, to), NONE)
        which = high.argmin(axis=1)
        second = high[np.arange(len(at)), which]
        better = (least < self.best[k, at]) | (first < self.low[k, at]) | ((first == self.low[k, at]) & (second < self.high[k, at]))
        at = at[better]
        self.best[k, at], self.low[k, at], self.high[k, at], self.other[k, at] = least[better], first[better], second[better], keys[which[better]]
        np.minimum.at(self.least[k], self.part[k][at], least[better])

    def found(self):
        if self.places is None:
            return
        for k, t in enumerate(self.largest):
            some = np.flatnonzero(np.isfinite(self.best[k]))
            key, w, low, high, other = self.keys[t, some], self.best[k, some], self.low[k, some], self.high[k, some], self.other[k, some]
            order = np.lexsort((high, low, w, key))
            order = order[np.flatnonzero(np.diff(key[order], prepend=-1))]  # one row for each component
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (key, w, low, high, other)], names=["key", "w", "a", "b", "other"])


def _trees_by_blocks(placed: DataFrame, n: int, samples: list[int], blocks: int) -> DataFrame:
    """(tree: its samples, a, b, w): the edges of all trees, whose rounds go on together, so that vectors are compared once a round for all of them."""
    wide = len(samples)
    placed, blocks = _in_blocks(placed, n, blocks)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        values = {"places": table["place"].to_numpy(), "matrix": _flat(table, "p")} | ({"cores": np.ascontiguousarray(_flat(table, "cores").T)} if "cores" in table.schema.names else {})
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in values.items()})

    def pack_keys(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("slot", "ascending")])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "keys": pa.array([table["key"].to_numpy().tobytes()], pa.binary())})

    bare = settled(placed.groupBy("block").applyInArrow(pack, "block long, places binary, matrix binary"))
    k = min(max(samples), n - 1) + 1
    near = _grid(bare, blocks).mapInArrow(_met(lambda: _Near(k)), "place long, near array<double>")
    sorted_ = near.groupBy("place").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("x"))
    cores = sorted_.select("place", F.array(*[F.get("x", F.lit(min(s, n - 1))) for s in samples]).alias("cores"))
    points = settled(placed.join(cores, "place").groupBy("block").applyInArrow(pack, "block long, places binary, matrix binary, cores binary"))

    # A component's key is its tree's number times n plus its least place.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long")))
    labels = settled(placed.select("block", "slot", "place", every.alias("tree")).select("block", "slot", "tree", (F.col("tree") * n + F.col("place")).alias("key")))
    edges = None
    while True:
        sizes = labels.groupBy("tree", "key").count().groupBy("tree").agg(F.count(F.lit(1)).alias("parts"), F.max_by("key", "count").alias("largest"))
        largest = {r["tree"]: r["largest"] for r in sizes.collect() if r["parts"] > 1}  # a row for each tree, eight at most
        if not largest:
            break
        keys = labels.groupBy("block").applyInArrow(pack_keys, "block long, keys binary")
        found = _grid(settled(points.join(keys, "block")), blocks).mapInArrow(_met(lambda largest=largest: _Out(largest)), "key long, w double, a long, b long, other long")
        picked = settled(found.groupBy("key").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("key", "e.*"))
        edges = picked if edges is None else edges.unionByName(picked)
        wholes = connected_components(picked.select("key", "other"), small=condensing.CHUNK, apart=F.floor(F.col("key") / n)).select(F.col("node").alias("key"), "component")
        labels = settled(labels.join(wholes, "key", "left").select("block", "slot", "tree", F.coalesce("component", "key").alias("key")))
    tree = F.element_at(F.array(*[F.lit(s) for s in samples]), (F.floor(F.col("key") / n) + 1).cast("int")).alias("tree")
    return settled(edges.select(tree, "a", "b", "w").distinct())  # two components may pick the same edge


def kmeans(vectors: DataFrame, k: int, seed: int = 42, with_strength: bool = False) -> DataFrame:
    """(id, cluster) by MLlib k-means: linear in the vectors, without noise, for whoever asks for it.

    ``strength``, if wanted, is 1 - distance to the own centre / distance to the next one: 1 at the centre, 0 halfway between two.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, seed=seed).fit(rows)
    found = model.transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"), "v")
    if not with_strength:
        return found.drop("v")
    centres = np.array(model.clusterCenters())

    def measure(batches):
        for batch in batches:
            if not len(batch):
                continue
            points, own = np.stack(batch["v"].to_numpy()), batch["cluster"].to_numpy()
            away = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
            away = np.sqrt(np.maximum(away, 0))
            at = np.arange(len(points))
            near = away[at, own]
            away[at, own] = np.inf
            other = np.maximum(away.min(axis=1), 1e-12)
            yield pd.DataFrame({"id": batch["id"], "cluster": own, "strength": np.clip(1 - near / other, 0, 1)})

    return found.mapInPandas(measure, "id long, cluster long, strength double")
