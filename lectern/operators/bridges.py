"""Bridges: which regions lean towards each other, and by which papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import dot, unit, unit_centroids


def find_bridges(
    vectors: DataFrame,
    dim: int = 64,
    min_similarity: float = fixed.BRIDGE_SIMILARITY,
    min_affinity: float = fixed.BRIDGE_SIMILARITY,
    boundary_strength: float = fixed.BOUNDARY_STRENGTH,
    quantile: float = fixed.BRIDGE_QUANTILE,
    most: int = fixed.MAX_LINKS,
    most_papers: int = fixed.MAX_BRIDGE_PAPERS,
) -> DataFrame:
    """(source_id, target_id, similarity, paper_ids) of linked clusters.

    Input: id, v, cluster (-1: none), strength (null counts as 1).  Pairs are those of
    centroids at least ``min_similarity`` and the quantile of all pairs; a link needs a paper of
    either side, not firmly inside, that leans to the other.  Of those the six most attracted stand,
    ties by higher id.
    """
    members = vectors.where("cluster <> -1")
    centres = unit_centroids(members, "cluster", dim=dim).select("cluster", "centroid")
    left = centres.select(F.col("cluster").alias("source_id"), F.col("centroid").alias("a"))
    right = centres.select(F.col("cluster").alias("target_id"), F.col("centroid").alias("b"))
    pairs = left.join(right, F.col("source_id") < F.col("target_id")).select("source_id", "target_id", "a", "b", dot(F.col("a"), F.col("b")).alias("similarity"))
    pairs = pairs.cache()
    floor = pairs.agg(F.greatest(F.percentile("similarity", quantile), F.lit(min_similarity)).alias("floor"))
    near = pairs.crossJoin(F.broadcast(floor)).where(F.col("similarity") >= F.col("floor"))
    sides = near.select("source_id", "target_id", F.col("source_id").alias("cluster"), F.col("b").alias("other")).unionByName(near.select("source_id", "target_id", F.col("target_id").alias("cluster"), F.col("a").alias("other")))
    loose = members.where(F.coalesce("strength", F.lit(1.0)) <= boundary_strength).select("id", "cluster", unit(F.col("v")).alias("u"))
    leaning = loose.join(sides, "cluster").select("source_id", "target_id", "id", dot(F.col("u"), F.col("other")).alias("affinity")).where(F.col("affinity") >= min_affinity)
    order = Window.partitionBy("source_id", "target_id").orderBy(F.desc("affinity"), F.desc("id"))
    top = leaning.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_papers)
    papers = top.groupBy("source_id", "target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("paper_ids"))
    links = near.select("source_id", "target_id", F.round("similarity", 4).alias("similarity")).join(papers, ["source_id", "target_id"])
    return links.orderBy(F.desc("similarity"), "source_id", "target_id").limit(most)
