"""The map of a library: placing new vectors, deciding on a refit, aligned refits, clusters and links; runs as tables.

A run is a set of Parquet tables under its number; which run is shown is one pointer row, written last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partitions import indexed
from . import bridges, catalog, clustering, maps, neighbours, umap

MIN_SHARED = 4


@dataclass
class Outcome:
    run_id: int
    refitted: bool
    placed: int
    total: int
    clusters: int
    reason: str
    displacement: float | None = None


class MapStore:
    """Runs and the pointer to the active one, in one folder that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, run_id: int, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        path = f"{self.root}/run-{run_id}/{name}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.parquet(path)

    def read(self, run_id: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/run-{run_id}/{name}")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/active")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def active(self) -> int | None:
        """The run that was switched to last."""
        rows = self._pointers()
        return None if rows is None else rows.agg(F.max_by("run_id", "turn")).first()[0]

    def activate(self, run_id: int) -> None:
        rows = self._pointers()
        turn = 0 if rows is None else rows.agg(F.max("turn")).first()[0] + 1
        self.spark.createDataFrame([(turn, run_id)], "turn long, run_id long").coalesce(1).write.mode("append").parquet(f"{self.root}/active")


def _projected(store: MapStore, run_id: int, new: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, x, y, z) of new vectors as the run's own layout has them, before its alignment."""
    row = store.read(run_id, "model").first()
    if row["layout"] == "umap":
        raw = store.read(run_id, "raw")
        return _axes(umap.place(new, fitted, raw.select("id", F.array(*maps.AXES).alias("p"))))
    return maps.project(new, np.array(row["mean"]), np.array(row["components"]).reshape(len(row["mean"]), -1))


def _axes(places: DataFrame) -> DataFrame:
    return places.select("id", *[F.col("p")[k].alias(c) for k, c in enumerate(maps.AXES)])


def _place_new(store: MapStore, run_id: int, vectors: DataFrame) -> int:
    """Places vectors that the run lacks; places it has stay as they are."""
    placed = store.read(run_id, "places")
    new = vectors.join(placed.select("id"), "id", "left_anti").cache()
    n = new.count()
    if n:
        fitted = vectors.join(placed.where(~F.col("is_transformed")).select("id"), "id", "left_semi")
        rows = _projected(store, run_id, new, fitted).join(neighbours.drift(new, fitted).withColumnRenamed("drift", "off_manifold"), "id")
        rows = _aligned(store, run_id, rows)
        store.write(run_id, "places", rows.select("id", "x", "y", "z", F.lit(True).alias("is_transformed"), "off_manifold"), "append")
    new.unpersist()
    return n


def _aligned(store: MapStore, run_id: int, rows: DataFrame) -> DataFrame:
    """Applies the run's own alignment to freshly projected places."""
    m = store.read(run_id, "alignment").first()
    matrix, shift = np.array(m["matrix"]).reshape(3, 3), m["shift"]
    moved = [sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(maps.AXES)), F.lit(float(shift[j]))).alias(e) for j, e in enumerate(maps.AXES)]
    return rows.select("id", *moved, *[c for c in rows.columns if c not in ("id", *maps.AXES)])


def write_clusters(vectors: DataFrame, titles: DataFrame, dim: int, method: str = "density") -> tuple[DataFrame, DataFrame]:
    """(members: id, cluster, strength; clusters: cluster, size, label, method, centroid's first 32 values, terms).

    ``method`` is "density", "neighbourhoods" (density after a layout by neighbourhoods on ten axes) or, where comparing all pairs is too much, "k-means": the
    caller's choice at any size.
    """
    if method in ("density", "neighbourhoods"):
        members = clustering.cluster_vectors(vectors, by="pca" if method == "density" else "umap")
    else:
        members = clustering.kmeans(vectors, max(2, round((vectors.count() / 2) ** 0.5)), with_strength=True)
    from ..functions.vectors import centroids

    own = vectors.join(members.where("cluster <> -1"), "id")
    named = titles.join(members.where("cluster <> -1"), "id").select("cluster", F.col("id").alias("ord"), F.coalesce("title", F.lit("")).alias("title"))
    terms = catalog.top_terms(named, ["cluster"]).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    rows = centroids(own, "cluster", dim=dim).join(terms, "cluster", "left")
    label = F.concat(F.lit("Region "), F.col("cluster").cast("string"))
    return members, rows.select("cluster", "size", label.alias("label"), F.lit(method).alias("method"), F.slice("centroid", 1, 32).alias("centroid"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def write_links(vectors: DataFrame, members: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """Bridges between clusters, with the terms they share in the order of the source's."""
    found = bridges.find_bridges(vectors.join(members, "id"), dim)
    t = clusters.select("cluster", "terms")
    left, right = t.select(F.col("cluster").alias("source_id"), F.col("terms").alias("a")), t.select(F.col("cluster").alias("target_id"), F.col("terms").alias("b"))
    return found.join(left, "source_id", "left").join(right, "target_id", "left").select("source_id", "target_id", "similarity", "paper_ids", catalog.shared_terms(F.col("a"), F.col("b")).alias("shared_terms"))


def project_corpus(store: MapStore, vectors: DataFrame, titles: DataFrame, dim: int, force: bool = False, method: str = "density", layout: str = "pca") -> Outcome:
    """Places new vectors, and refits once too many were only placed or drifted, or on request.

    A refit goes into a new run, is turned onto the last one by the papers they share (four at least), and is
    shown only when complete.  Input: vectors (id, v), titles (id, title).  A refit's ``layout`` is "pca" or "umap" (new vectors are then
    placed among their neighbours), its clusters go by ``method`` (see write_clusters).
    """
    if layout not in ("pca", "umap"):
        raise ValueError("no such layout")
    spark, run = store.spark, store.active()
    total = vectors.count()
    if not total:
        raise ValueError("no vectors to place")
    placed, reason = 0, "first map" if run is None else "refit requested" if force else ""
    if run is not None and not force:
        placed = _place_new(store, run, vectors)
        if not catalog.should_refit(store.read(run, "places")).first()["refit"]:
            return Outcome(run, False, placed, total, store.read(run, "clusters").count(), "")
        reason = "too many papers were only placed, or drifted"
    new = 0 if run is None else run + 1
    mean, components = maps.fit_pca(vectors, dim)
    store.write(new, "model", spark.createDataFrame([(mean.tolist(), components.ravel().tolist(), layout)], "mean array<double>, components array<double>, layout string"))
    coords = store.write(new, "raw", _axes(umap.layout(vectors)) if layout == "umap" else maps.project(vectors, mean, components))
    matrix, shift, displacement = np.eye(3), np.zeros(3), None
    if run is not None:
        before = store.read(run, "places").select("id", *maps.AXES)
        if coords.join(before, "id", "left_semi").count() >= MIN_SHARED:
            matrix, shift = maps.alignment(coords, before)
    store.write(new, "alignment", spark.createDataFrame([(matrix.ravel().tolist(), shift.tolist())], "matrix array<double>, shift array<double>"))
    rows = _aligned(store, new, coords)
    rows = store.write(new, "places", rows.select("id", "x", "y", "z", F.lit(False).alias("is_transformed"), F.lit(0.0).alias("off_manifold")))
    if run is not None:
        displacement = catalog.mean_displacement(store.read(run, "places"), rows).first()["displacement"]
    store.write(new, "skeleton", neighbours.skeleton(vectors))
    members, clusters = write_clusters(vectors, titles, dim, method)
    members, clusters = store.write(new, "members", members), store.write(new, "clusters", clusters)
    store.write(new, "links", write_links(vectors, members, clusters, dim))
    store.activate(new)
    return Outcome(new, True, total, total, clusters.count(), reason, displacement)


def alternative_run(store: MapStore, vectors: DataFrame, dim: int) -> Outcome:
    """A second set of vectors laid out beside the active map, turned onto it, and not shown."""
    run = store.active()
    if run is None:
        raise ValueError("there is no map to compare with")
    before = store.read(run, "places")
    mean, components = maps.fit_pca(vectors, dim)
    aligned = maps.align(maps.project(vectors, mean, components), before)
    alt = store.write(run, "alternative", aligned)
    moved = catalog.mean_displacement(before, alt).first()
    return Outcome(run, False, alt.count(), alt.count(), 0, "alternative", moved["displacement"])


def graph_payload(store: MapStore, papers: DataFrame, paper_tags: DataFrame) -> tuple[DataFrame, str]:
    """One row per place: node index, position as packed 32-bit floats, and what the list shows; and the ETag of the whole."""
    run = store.active()
    places = store.read(run, "places")
    nodes = indexed(places, "id", name="node_index")
    edges = store.read(run, "skeleton")
    index = nodes.select("id", "node_index")
    pairs = edges.join(index.select(F.col("id").alias("a"), F.col("node_index").alias("i")), "a").join(index.select(F.col("id").alias("b"), F.col("node_index").alias("j")), "b").count()
    tags = catalog.tag_vocabulary(paper_tags).withColumnRenamed("paper_id", "id")
    members = store.read(run, "members")
    rows = nodes.join(papers.select("id", "title", "year", "pages"), "id", "left").join(members, "id", "left").join(tags, "id", "left")
    out = rows.select("range", "node_index", "id", "title", "year", "pages", F.col("cluster"), F.coalesce("tag_ids", F.array().cast("array<int>")).alias("tags"), F.round("strength", 3).alias("confidence"), F.col("is_transformed").alias("provisional"), F.round(F.coalesce("off_manifold", F.lit(0.0)), 2).alias("drift"), F.array(*[F.col(c).cast("float") for c in maps.AXES]).alias("position"))
    return out, f'W/"run-{run}-{places.count()}-s{pairs}"'



def payload_blocks(nodes: DataFrame) -> DataFrame:
    """(range, first, n, positions, clusters, flags): the payload's numbers as packed little-endian blocks, one for each range of node indices.

    Positions are three 32-bit floats a node, clusters 32-bit integers (-1: none), flags a byte (1: provisional).  Blocks one after the other, by ``first``,
    are the arrays of the whole.
    """

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_index")
        places = table["position"].combine_chunks().flatten().to_numpy().astype("<f4")
        clusters = table["cluster"].fill_null(-1).to_numpy().astype("<i4")
        flags = table["provisional"].fill_null(False).to_numpy(zero_copy_only=False).astype("u1")
        packed = {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("positions", places), ("clusters", clusters), ("flags", flags))}
        return pa.table({"range": pa.array([table["range"][0].as_py()], pa.int32()), "first": pa.array([table["node_index"][0].as_py()], pa.int64()), "n": pa.array([len(table)], pa.int64())} | packed)

    return nodes.select("range", "node_index", "position", "cluster", "provisional").groupBy("range").applyInArrow(pack, "range int, first long, n long, positions binary, clusters binary, flags binary")
