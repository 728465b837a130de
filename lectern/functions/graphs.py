"""Connected components of a graph in a DataFrame, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize, scratch


def _contract(batches):
    """Union-find over each batch of edges: its spanning forest, every node under its least one."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))], np.int64)
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def _joined(batches):
    """(node, component) of all edges of a partition."""
    batches = list(batches)
    edges = pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []
    for forest in _contract(edges):
        node, root = forest["u"].to_numpy(), forest["v"].to_numpy()
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], names=["node", "component"])


def connected_components(edges: DataFrame, most_rounds: int = 60, small: int = 0, apart: Column | None = None) -> DataFrame:
    """(node, component: its least node) for every node of ``edges`` (two long columns); loops are dropped.

    Large-star and small-star steps alternate until each node hangs below the
    least node of its component.  Edges are (u, v) with u above v throughout.
    Only nodes with a smaller neighbour are relabelled in a join; both sides of it
    are tables, so hot nodes are split at run time.  Rounds grow with the logarithm of the longest path; more than
    ``most_rounds`` raise an error.  Up to ``small`` edges are joined by one task, in one round.
    ``apart`` tells graphs apart that share no node, 0 and up, over the columns of ``edges``: such a bound holds for each of them, and each has a task.
    """
    if small:
        a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
        own = edges.select(a.cast("long").alias("u"), b.cast("long").alias("v"), (F.lit(0) if apart is None else apart).cast("int").alias("graph"))
        sizes = own.groupBy("graph").count().agg(F.max("count").alias("most"), F.max("graph").alias("last")).first()
        if (sizes["most"] or 0) <= small:
            dealt = own.where("u <> v").repartitionById((sizes["last"] or 0) + 1, F.col("graph")).select("u", "v")
            return materialize(dealt.mapInArrow(_joined, "node long, component long"), "cc-components")
    with scratch(edges.sparkSession) as keep:
        return keep(_settle(edges, most_rounds), "cc-components")


def _settle(edges: DataFrame, most_rounds: int) -> DataFrame:
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    current = materialize(rows.mapInArrow(_contract, "u long, v long").distinct(), "cc-edges")
    for _ in range(most_rounds):
        parents = current.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        parents = materialize(parents, "cc-parents")
        roots = parents.where("n > 1").limit(1)
        deeper = parents.select(F.col("u").alias("p")).join(parents.select(F.col("m").alias("p")), "p", "left_semi").limit(1)
        if roots.isEmpty() and deeper.isEmpty():
            return parents.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(parents.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        # Large star: what hangs below u hangs below u's least neighbour.
        moved = current.select(F.col("v").alias("p"), F.col("u").alias("w")).join(parents.select(F.col("u").alias("p"), "m"), "p", "left")
        large = moved.select(F.col("w").alias("u"), F.coalesce("m", "p").alias("v"))
        kept = parents.select("u", F.col("m").alias("v"))
        current = materialize(large.unionByName(kept).mapInArrow(_contract, "u long, v long").distinct(), "cc-large")
        # Small star: a node's smaller neighbours hang below the least of them.
        least = materialize(current.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        others = current.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(others.unionByName(least.select("u", F.col("m").alias("v"))).mapInArrow(_contract, "u long, v long").distinct(), "cc-small")
    raise RuntimeError("components did not settle")
