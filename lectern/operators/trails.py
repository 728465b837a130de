"""Trails between two papers over the neighbour graph."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.partitions import spread
from ..functions.tables import scratch, settled, shared_dir

#: Edges up to which one task searches the graph by a heap; beyond, distances are relaxed in DataFrames.
HEAP_EDGES = 2_000_000


def dijkstra(edges: dict[int, list[tuple[int, float]]], start: int, goal: int) -> list[int] | None:
    """The cheapest route; of equal ones that over lower ids."""
    best, before, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        cost, node = heapq.heappop(heap)
        if cost > best[node]:
            continue
        if node == goal:
            route = [goal]
            while route[-1] != start:
                route.append(before[route[-1]])
            return route[::-1]
        for other, step in edges.get(node, ()):
            total = cost + step
            if total < best.get(other, np.inf):
                best[other], before[other] = total, node
                heapq.heappush(heap, (total, other))
    return None


def greedy_walk(edges: dict[int, list[tuple[int, float]]], likeness: dict[int, float], start: int, goal: int, steps: int = fixed.MAX_GREEDY_STEPS) -> list[int]:
    """Climbs to ever more similar neighbours, then jumps to the goal."""
    route = [start]
    while len(route) <= steps and route[-1] != goal:
        here = route[-1]
        better = [(likeness[o], -o) for o, _ in edges.get(here, ()) if o not in route and likeness[o] > likeness[here]]
        if not better:
            break
        route.append(-max(better)[1])
    return route if route[-1] == goal else [*route, goal]


def thin(stops: list[int], limit: int = fixed.MAX_STOPS) -> list[int]:
    """At most ``limit`` stops, both ends and an even sample between."""
    if len(stops) <= limit:
        return list(stops)
    n = max(limit, 2)
    places = sorted({round(k * (len(stops) - 1) / (n - 1)) for k in range(n)})
    return [stops[p] for p in places]


def find_paths(edges: DataFrame, vectors: DataFrame, ends: DataFrame) -> DataFrame:
    """(trail, place, id, complete, hops) for each (trail, start, goal).

    A graph of at most HEAP_EDGES (checked) is packed once, sent to the executors once, and searched there by a heap, trail by trail; a larger one is
    searched by joins, with the same rows.  The shared folder is asked for at any size; tables go when the result is written.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    with scratch(spark) as keep:
        links = settled(edges.select("a", "b", "distance"))
        found = _by_heap(links, ends) if links.count() <= HEAP_EDGES else _cheapest(links, ends)
        return keep(_shown(links, found, ends, vectors), "trails")


def _by_heap(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(trail, route) of the trails whose goal can be reached."""
    spark = edges.sparkSession
    packed = edges.orderBy("a", "b").toArrow()  # HEAP_EDGES rows of three numbers
    shared = spark.sparkContext.broadcast(tuple(packed[c].to_numpy() for c in ("a", "b", "distance")))

    def search(batches):
        source, target, weight = shared.value
        nodes, first = np.unique(source, return_index=True)
        last = np.r_[first[1:], len(source)]
        place = {int(x): k for k, x in enumerate(nodes)}

        class Neighbours:
            """Edges of a node, read off the packed arrays."""

            def get(self, node, _):
                k = place.get(node)
                return () if k is None else zip(target[first[k] : last[k]].tolist(), weight[first[k] : last[k]].tolist(), strict=True)

        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            routes = pa.array([[s] if s == g else dijkstra(Neighbours(), s, g) for s, g in pairs], pa.list_(pa.int64()))
            known = routes.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), routes.filter(known)], names=["trail", "route"])

    kind = dict(ends.dtypes)["trail"]
    return spread(ends.select("trail", "start", "goal")).mapInArrow(search, f"trail {kind}, route array<long>")


def _shown(edges: DataFrame, found: DataFrame, ends: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """The stops of all trails; those without a way walk greedily, or show their two ends where there are no vectors."""
    found = settled(found)
    lost = settled(ends.join(found.select("trail"), "trail", "left_anti").select("trail", "start", "goal"))
    route = F.array("start", "goal")
    if vectors is not None:
        lost = lost.join(_walks(edges, vectors, lost), "trail", "left")
        route = F.coalesce("route", route)
    every = found.select("trail", "route").withColumn("complete", F.lit(True)).unionByName(lost.select("trail", route.alias("route"), F.lit(False).alias("complete")))
    return every.select("trail", F.posexplode(thinned(F.col("route"))).alias("place", "id"), "complete", (F.size("route") - 1).alias("hops"))


def relax_paths(edges: DataFrame, ends: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """As find_paths, by joins alone, for graphs that no task can hold.

    Trails that find no way walk greedily over ``vectors``; without these they are reported by their two ends.
    """
    edges = settled(edges.select("a", "b", "distance"))
    return _shown(edges, _cheapest(edges, ends), ends, vectors)


def thinned(stops: Column, limit: int = fixed.MAX_STOPS) -> Column:
    """As thin, of a column of stops."""
    n = max(limit, 2)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.size(stops) - 1) / (n - 1)).cast("int")))
    return F.when(F.size(stops) <= limit, stops).otherwise(F.transform(places, lambda p: F.get(stops, p)))


#: What sums in another order may differ by, as a share.
_ROUNDING = 1e-9


def _relaxed(labels: DataFrame, front: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, cost, old) after one round: what ``front`` reaches over ``links`` (a, b, distance), beside what was known."""
    step = front.withColumnRenamed("node", "a").join(links, ["a", *(c for c in keys if c in links.columns)])
    step = step.select(*keys, F.col("b").alias("node"), (F.col("cost") + F.col("distance")).alias("cost"), F.lit(None).cast("double").alias("old"))
    merged = labels.select(*keys, "node", "cost", F.col("cost").alias("old")).unionByName(step)
    return merged.groupBy(*keys, "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old"))


def _cheapest(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(trail, route) of the trails whose goal can be reached: least costs from both ends by repeated joins, then back from the goal.

    A round extends all nodes that improved on either side.  Once the sides meet, half of the best cost so far is as far as either has to
    extend: the middle of the best way lies there.  Then the forward side goes on over the nodes that the other one shows to be on a best
    way.  Distances are positive.  Of equal ways that over the earlier and lower predecessor stands, as the heap has it.
    """
    links = settled(edges.select(F.lit(0).alias("side"), "a", "b", "distance").unionByName(edges.select(F.lit(1).alias("side"), F.col("b").alias("a"), F.col("a").alias("b"), "distance")))
    starts = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("node")), F.struct(F.lit(1).alias("side"), F.col("goal").alias("node")))).alias("x")
    labels = settled(ends.select("trail", starts).select("trail", "x.side", "x.node", F.lit(0.0).alias("cost")))
    front = labels
    while True:
        met = labels.groupBy("trail", "node").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("sides")).where("sides = 2")
        bound = settled(met.groupBy("trail").agg(F.min("cost").alias("bound")))  # one row per trail
        front = front.join(bound, "trail", "left").where(F.col("bound").isNull() | (F.col("cost") <= F.col("bound") * (0.5 + _ROUNDING))).drop("bound")
        if front.isEmpty():
            break
        chosen = settled(_relaxed(labels, front, links, ["trail", "side"]))
        front, labels = chosen.where("old IS NULL OR cost < old").drop("old"), chosen.drop("old")

    # Only nodes whose way to the goal fits into the best cost are gone on from; where the other side hasn't been, it is more than half of that.
    rest = settled(labels.where("side = 1").select("trail", "node", F.col("cost").alias("rest")))
    fits = lambda rows: rows.join(bound, "trail").join(rest, ["trail", "node"], "left").where(F.col("cost") + F.coalesce("rest", F.col("bound") / 2) <= F.col("bound") * (1 + _ROUNDING)).select("trail", "node", "cost")
    best = settled(fits(labels.where("side = 0").select("trail", "node", "cost")))
    front = best
    while not front.isEmpty():
        chosen = settled(_relaxed(best, front, edges, ["trail"]))
        front = fits(chosen.where("old IS NULL OR cost < old").drop("old"))
        best = settled(fits(chosen.drop("old")))
        front = front.join(best.select("trail", "node", F.col("cost").alias("_c")), ["trail", "node"]).where("cost = _c").drop("_c")
    best = best.join(ends.select("trail", "goal"), "trail")

    into = edges.select(F.col("a").alias("before"), F.col("b").alias("node"), "distance")
    costs = best.select("trail", F.col("node").alias("before"), F.col("cost").alias("before_cost"))
    here = best.where("node = goal").join(ends.select("trail", "start"), "trail").select("trail", "start", "node", "cost", F.array("node").alias("route"))
    here = settled(here)
    while not here.where("node <> start").isEmpty():
        step = here.where("node <> start").join(into, "node").join(costs, ["trail", "before"]).where("before_cost + distance = cost")
        step = step.groupBy("trail").agg(F.min(F.struct("before_cost", "before")).alias("m"))
        moved = F.col("m").isNotNull()
        here = here.join(F.broadcast(step), "trail", "left").select(
            "trail",
            "start",
            F.when(moved, F.col("m.before")).otherwise(F.col("node")).alias("node"),
            F.when(moved, F.col("m.before_cost")).otherwise(F.col("cost")).alias("cost"),
            F.when(moved, F.concat(F.array("m.before"), "route")).otherwise(F.col("route")).alias("route"),
        )
        here = settled(here)
    return here.select("trail", "route")


def _walks(edges: DataFrame, vectors: DataFrame, ends: DataFrame, steps: int = fixed.MAX_GREEDY_STEPS) -> DataFrame:
    """(trail, route) as greedy_walk: likeness grows with each step, so no stop comes twice."""
    from ..functions.vectors import dot, unit

    units = vectors.select(F.col("id").alias("node"), unit(F.col("v")).alias("u"))
    here = ends.select("trail", F.col("start").alias("node"), "goal").join(units.select(F.col("node").alias("goal"), F.col("u").alias("g")), "goal").join(units, "node")
    here = here.select("trail", "goal", "g", "node", dot(F.col("u"), F.col("g")).alias("likeness"), F.array("node").alias("route"), (F.col("node") != F.col("goal")).alias("open"))
    here = settled(here)
    for _ in range(steps):
        if here.where("open").isEmpty():
            break
        step = here.where("open").select("trail", "g", F.col("node").alias("a"), F.col("likeness").alias("least")).join(edges.select("a", F.col("b").alias("node")), "a").join(units, "node")
        step = step.select("trail", "node", "least", dot(F.col("u"), F.col("g")).alias("near")).where("near > least")
        step = step.groupBy("trail").agg(F.max(F.struct("near", (-F.col("node")).alias("minus"))).alias("m")).select("trail", "m.near", (-F.col("m.minus")).alias("next"))
        moved = F.col("next").isNotNull()
        here = here.join(step, "trail", "left").select(
            "trail",
            "goal",
            "g",
            F.coalesce("next", "node").alias("node"),
            F.coalesce("near", "likeness").alias("likeness"),
            F.when(moved, F.concat("route", F.array("next"))).otherwise(F.col("route")).alias("route"),
            (moved & (F.col("next") != F.col("goal"))).alias("open"),
        )
        here = settled(here)
    return here.select("trail", F.when(F.col("node") == F.col("goal"), F.col("route")).otherwise(F.concat("route", F.array("goal"))).alias("route"))
