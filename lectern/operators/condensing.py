"""Density clusters from a spanning tree that no task holds: merges, condensing, stabilities and choice as tables.

*Merges*: edges get their rank by weight.  Ranks are halved again and again: the components that the lighter half of a stretch makes are single vertices
to the heavier half, named by their last merge, so after log(n / CHUNK) levels every stretch of CHUNK edges stands for itself, and
one task a stretch names the two sides of each merge.

*Condensing*: a side of at least ``floor`` points carries its parent's cluster on, or starts one where the other side is as large; who starts above a
node, and what a point falls out of, are found by pointer jumping, in rounds that grow with the logarithm of the depth.

*Stabilities* are sums over points and split-off clusters; the choice (excess of mass) goes up the clusters in the order of their nodes,
CHUNK of each floor's a round, since they may lie as deep as there are many.  All floors go the same way at once, under their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import connected_components
from ..functions.partitions import indexed
from ..functions.tables import materialize

#: Edges or clusters of one stretch, at most.
CHUNK = 1_000_000
#: Densities above count as this one.
MOST = 1e12


def _sides(n: int):
    """For a stretch of edges in their order: what each merges, and how many points."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rank, w = table["rank"].to_numpy(), table["w"].to_numpy()
        ends = np.stack([table["x"].to_numpy(), table["y"].to_numpy()])
        names, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        size = np.zeros(len(names), np.int64)
        size[at[0]], size[at[1]] = table["sx"].to_numpy(), table["sy"].to_numpy()
        parent, node, points = list(range(len(names))), names.tolist(), size.tolist()
        out = np.zeros((4, len(rank)), np.int64)
        for k, (a, b) in enumerate(zip(at[0].tolist(), at[1].tolist(), strict=True)):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            out[:, k] = node[a], node[b], points[a], points[b]
            parent[b] = a
            node[a], points[a] = n + int(rank[k]), points[a] + points[b]
        return pa.table({"node": pa.array(n + rank), "left": pa.array(out[0]), "right": pa.array(out[1]), "left_size": pa.array(out[2]), "right_size": pa.array(out[3]), "w": pa.array(w)})

    return run


def merges(tree: DataFrame, n: int, chunk: int = 0) -> DataFrame:
    """(node, left, right, left_size, right_size, w) of every merge of a spanning tree (a, b, w) over points 0 to n - 1; nodes are n + rank."""
    chunk = chunk or CHUNK
    ranked = indexed(tree.select("a", "b", "w"), "w", "a", "b", name="rank")
    edges = ranked.select("rank", "w", F.col("a").cast("long").alias("x"), F.lit(1).cast("long").alias("sx"), F.col("b").cast("long").alias("y"), F.lit(1).cast("long").alias("sy"))
    width = chunk
    while width < n - 1:
        width *= 2
    while width > chunk:
        width //= 2
        edges = materialize(edges, "merge-edges")
        heavy = F.floor(F.col("rank") / width) % 2 == 1
        light = edges.where(~heavy)
        parts = connected_components(light.select("x", "y"))
        vertices = light.select(F.col("x").alias("node"), F.col("sx").alias("s")).unionByName(light.select(F.col("y").alias("node"), F.col("sy").alias("s"))).distinct()
        sizes = vertices.join(parts, "node").groupBy("component").agg(F.sum("s").alias("s"))
        last = light.select(F.col("x").alias("node"), "rank").join(parts, "node").groupBy("component").agg((F.max("rank") + n).alias("top"))
        named = materialize(parts.join(sizes, "component").join(last, "component").select("node", "top", "s"), "merge-names")
        for end, size in (("x", "sx"), ("y", "sy")):
            own = named.select(F.col("node").alias(end), F.col("top").alias("_t"), F.col("s").alias("_s"))
            edges = edges.join(own, end, "left").withColumn(end, F.when(heavy, F.coalesce("_t", end)).otherwise(F.col(end))).withColumn(size, F.when(heavy, F.coalesce("_s", size)).otherwise(F.col(size))).drop("_t", "_s")
    work = edges.withColumn("stretch", F.floor(F.col("rank") / chunk))
    return materialize(work.groupBy("stretch").applyInArrow(_sides(n), "node long, left long, right long, left_size long, right_size long, w double"), "merges")


def _jumped(pointers: DataFrame, settled: Column) -> DataFrame:
    """(key, node, to) with ``to`` followed until it is ``settled`` (over columns key, node, to, done)."""
    current = materialize(pointers, "jump")
    while not current.where(~settled).isEmpty():
        ahead = current.select("key", F.col("node").alias("to"), F.col("to").alias("_next"), F.col("done").alias("_done"))
        moved = current.join(ahead, ["key", "to"], "left")
        go = ~settled & F.col("_next").isNotNull()
        current = materialize(moved.select("key", "node", F.when(go, F.col("_next")).otherwise(F.col("to")).alias("to"), F.when(go, F.col("_done")).otherwise(F.col("done")).alias("done")), "jump")
    return current.drop("done")


def condensed(nodes: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters (key, cluster, parent, born, size) and points (key, point, cluster, density), for every (key, floor, n).

    ``nodes`` are the merges with their ``key``; a cluster is named by the node it starts at, the root's has no parent.
    """
    top = F.col("left_size") + F.col("right_size")
    rows = nodes.join(F.broadcast(floors), "tree").withColumn("size", top)  # a row for each floor
    density = F.when(F.col("w") > 0, F.least(1 / F.col("w"), F.lit(MOST))).otherwise(F.lit(MOST))
    side = lambda a, b: F.struct(F.col(a).alias("node"), F.col(f"{a}_size").alias("size"), F.col(f"{b}_size").alias("other"))
    below = rows.select("key", "floor", "n", F.col("node").alias("parent"), F.col("size").alias("parent_size"), density.alias("density"), F.explode(F.array(side("left", "right"), side("right", "left"))).alias("x"))
    below = materialize(below.select("key", "floor", "n", "parent", "parent_size", "density", "x.node", "x.size", "x.other"), "condense-below")
    large, starts = F.col("size") >= F.col("floor"), F.col("other") >= F.col("floor")
    root = floors.select("key", (2 * F.col("n") - 2).alias("node"))
    # From a large node to where its cluster starts: itself, or its parent's way.
    pointers = below.where(large).select("key", "node", F.when(starts, F.col("node")).otherwise(F.col("parent")).alias("to"), starts.alias("done"))
    pointers = pointers.unionByName(root.select("key", "node", F.col("node").alias("to"), F.lit(True).alias("done")))
    owners = materialize(_jumped(pointers, F.col("done")), "condense-owners")
    # From a small node to the large one that it falls out of.
    fall = below.where(~large & (F.col("parent_size") >= 2)).select("key", "node", F.col("parent").alias("to"), (F.col("parent_size") >= F.col("floor")).alias("done"))
    fallen = _jumped(fall, F.col("done"))
    out_at = below.where("parent_size >= floor").select("key", F.col("parent").alias("to"), "density").distinct()
    named = owners.select("key", F.col("node").alias("to"), F.col("to").alias("cluster"))
    points = fallen.join(floors.select("key", "n"), "key").where("node < n").join(out_at, ["key", "to"]).join(named, ["key", "to"]).select("key", F.col("node").alias("point"), "cluster", "density")
    born = below.where(large & starts).select("key", F.col("node").alias("cluster"), F.col("parent").alias("to"), F.col("density").alias("born"), "size")
    clusters = born.join(named.withColumnRenamed("cluster", "parent"), ["key", "to"]).select("key", "cluster", "parent", "born", "size")
    roots = root.join(floors.select("key", "n"), "key").select("key", F.col("node").alias("cluster"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("born"), F.col("n").alias("size"))
    return materialize(clusters.unionByName(roots), "condense-clusters"), materialize(points, "condense-points")


def _picks(table: pa.Table) -> pa.Table:
    """For a stretch of one key's clusters in their order: which are worth more than those below, and what each is worth; ``inner`` is what earlier stretches tell."""
    table = table.sort_by("cluster")
    cluster, own = table["cluster"].to_numpy(), table["own"].to_pylist()
    parent, inner = table["parent"].to_pylist(), table["inner"].to_pylist()
    place = {c: k for k, c in enumerate(cluster.tolist())}
    picked, worth = [False] * len(own), [0.0] * len(own)
    for k, (up, stability) in enumerate(zip(parent, own, strict=True)):
        picked[k] = up is not None and (inner[k] is None or stability >= inner[k])
        worth[k] = stability if picked[k] else inner[k] or 0.0
        above = place.get(up)
        if above is not None:
            inner[above] = (inner[above] or 0.0) + worth[k]
    return pa.table({"key": table["key"], "cluster": table["cluster"], "parent": table["parent"], "picked": pa.array(picked), "worth": pa.array(worth)})


def chosen(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(key, cluster, top): for each cluster the chosen one that it belongs to; those without one are left out."""
    lost = points.select("key", "cluster", "density", F.lit(1).cast("long").alias("size"))
    split = clusters.where("parent IS NOT NULL").select("key", F.col("parent").alias("cluster"), F.col("born").alias("density"), "size")
    own = lost.unionByName(split).join(clusters.select("key", "cluster", "born"), ["key", "cluster"])
    stability = own.groupBy("key", "cluster").agg(F.sum((F.col("density") - F.col("born")) * F.col("size")).alias("own"))
    state = clusters.join(stability, ["key", "cluster"], "left").select("key", "cluster", "parent", F.coalesce("own", F.lit(0.0)).alias("own"))
    # Clusters come before their parents in the order of nodes.
    ranked = indexed(state, "key", "cluster", name="at")
    first = ranked.groupBy("key").agg(F.min("at").alias("first"))  # a row for each key
    ranked = materialize(ranked.join(F.broadcast(first), "key").withColumn("stretch", F.floor((F.col("at") - F.col("first")) / CHUNK)).drop("at", "first"), "choose")
    state = None
    for stretch in range(ranked.agg(F.max("stretch")).first()[0] + 1):
        rows = ranked.where(F.col("stretch") == stretch).drop("stretch")
        if state is None:
            rows = rows.withColumn("inner", F.lit(None).cast("double"))
        else:
            told = state.where("parent IS NOT NULL").groupBy("key", F.col("parent").alias("cluster")).agg(F.sum("worth").alias("inner"))
            rows = rows.join(told, ["key", "cluster"], "left")
        made = materialize(rows.groupBy("key").applyInArrow(_picks, "key long, cluster long, parent long, picked boolean, worth double"), "choose")
        state = made if state is None else state.unionByName(made)
    # Of picked clusters on one way the uppermost stands: from each one to the last picked above it.
    pointers = state.select("key", F.col("cluster").alias("node"), F.coalesce("parent", "cluster").alias("to"), F.when(F.col("picked"), F.col("cluster")).alias("best"), F.col("parent").isNull().alias("done"))
    current = materialize(pointers, "choose-up")
    while not current.where("NOT done").isEmpty():
        ahead = current.select("key", F.col("node").alias("to"), F.col("to").alias("_next"), F.col("best").alias("_best"), F.col("done").alias("_done"))
        moved = current.join(ahead, ["key", "to"])
        current = materialize(moved.select("key", "node", F.when(F.col("done"), F.col("to")).otherwise(F.col("_next")).alias("to"), F.when(F.col("done"), F.col("best")).otherwise(F.coalesce("_best", "best")).alias("best"), (F.col("done") | F.col("_done")).alias("done")), "choose-up")
    return current.where("best IS NOT NULL").select("key", F.col("node").alias("cluster"), F.col("best").alias("top"))


def members(points: DataFrame, picked: DataFrame) -> DataFrame:
    """(key, point, top, density) of the points in chosen clusters."""
    return points.join(picked, ["key", "cluster"]).select("key", "point", "top", "density")


def validities(trees: DataFrame, floors: DataFrame, found: DataFrame) -> DataFrame:
    """(key, validity, clusters, share: of the largest one), one row a key: as relative_validity and dominant_share."""
    edges = trees.join(F.broadcast(floors.select("tree", "key")), "tree")
    label = lambda end, name: found.select("key", F.col("point").alias(end), F.col("top").alias(name))
    named = edges.join(label("a", "x"), ["key", "a"], "left").join(label("b", "y"), ["key", "b"], "left")
    same = F.col("x").eqNullSafe(F.col("y")) & F.col("x").isNotNull()
    inner = named.where(same).groupBy("key", F.col("x").alias("top")).agg(F.max("w").alias("inner"))
    outer = named.where(~same).select("key", "w", F.explode(F.array("x", "y")).alias("top")).where("top IS NOT NULL").groupBy("key", "top").agg(F.min("w").alias("outer"))
    sizes = found.groupBy("key", "top").agg(F.count(F.lit(1)).alias("size"))
    rows = sizes.join(inner, ["key", "top"], "left").join(outer, ["key", "top"], "left").join(F.broadcast(floors.select("key", "n")), "key")
    inside = F.coalesce("inner", F.lit(0.0))
    outside = F.coalesce("outer", inside)
    part = F.col("size") / F.col("n") * (outside - inside) / F.greatest(inside, outside, F.lit(1e-300))
    summed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("clusters"), F.sum(part).alias("validity"), (F.max("size") / F.max("n")).alias("share"))
    return summed.withColumn("validity", F.when(F.col("clusters") < 2, F.lit(-1.0)).otherwise(F.col("validity")))


def labelled(found: DataFrame) -> DataFrame:
    """(point, cluster, strength) of one key's members: clusters are numbered by their least point."""
    first = found.groupBy("top").agg(F.min("point").alias("first"), F.max("density").alias("most"))
    numbered = indexed(first, "first", name="cluster").select("top", "cluster", "most")
    strength = F.when(F.col("most") > 0, F.col("density") / F.col("most")).otherwise(F.lit(1.0))
    return found.join(numbered, "top").select("point", "cluster", strength.alias("strength"))
