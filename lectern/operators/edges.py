"""The neighbour graph as a table that follows the vectors: only what a change can reach is compared again.

A row holds a vector's LISTED nearest and a digest of the vector.  New and changed vectors are compared with all; of
the others, those that had one of the changed or removed ones in their list are compared with all as well, and the rest with the changed ones
alone, whose lists they join if they are near enough.  The lists are those of a rebuild.  An unchanged store is one comparison of digests.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.keyed import KeyedTable
from ..functions.tables import discard, materialize, scratch
from . import neighbours

#: Neighbours that a list holds: as many as any size of corpus asks for.
LISTED = 60


class Update(NamedTuple):
    """How many vectors were compared with all, compared with the changed ones alone, and removed; and how many lists were written."""

    whole: int
    partial: int
    removed: int
    written: int


def digest_of(vectors: DataFrame) -> DataFrame:
    """(id, v, digest): 128 bits of a vector's numbers."""
    numbers = F.array_join(F.transform("v", lambda x: x.cast("double").cast("string")), ",")
    return vectors.select(F.col("id").cast("long").alias("id"), "v", F.md5(numbers).alias("digest"))


def _lists(found: DataFrame) -> DataFrame:
    """(id, near: [(similarity, j)] by falling similarity, then lower j) from (i, j, similarity), a pair once."""
    entry = F.struct((-F.round("similarity", 12)).alias("minus"), "j", "similarity")
    near = F.slice(F.sort_array(F.collect_list(entry)), 1, LISTED)
    return found.groupBy(F.col("i").alias("id")).agg(F.transform(near, lambda x: F.struct(x["similarity"].alias("similarity"), x["j"].alias("j"))).alias("near"))


def update(table: KeyedTable, vectors: DataFrame) -> Update:
    """Brings the table (id, digest, near) up to ``vectors`` (id, distinct, and v)."""
    spark = vectors.sparkSession
    with scratch(spark):
        now = materialize(digest_of(vectors), "edges-now")
        known = table.read()
        if known is None:
            known = spark.createDataFrame([], "id long, digest string, near array<struct<similarity:double,j:long>>")
        both = now.select("id", F.col("digest").alias("new")).join(known.select("id", F.col("digest").alias("old")), "id", "full")
        turned = materialize(both.where(~F.col("new").eqNullSafe(F.col("old"))), "edges-turned")
        if turned.isEmpty():
            return Update(0, 0, 0, 0)
        changed = turned.where("new IS NOT NULL").select("id")
        removed = turned.where("new IS NULL").select("id")
        stale = turned.where("old IS NOT NULL").select(F.col("id").alias("j"))
        rest = known.join(turned.select("id"), "id", "left_anti")
        torn = rest.select("id", F.explode("near").alias("x")).select("id", "x.j").join(stale, "j", "left_semi").select("id").distinct()
        whole = materialize(changed.unionByName(torn), "edges-whole")
        asked, target = now.join(whole, "id", "left_semi").select("id", "v"), now.select("id", "v")
        fresh = neighbours.top_k(asked, target, LISTED).select("i", "j", "similarity")
        kept = materialize(rest.join(whole, "id", "left_anti"), "edges-kept")
        others = now.join(kept.select("id"), "id", "left_semi").select("id", "v")
        arrived = now.join(changed, "id", "left_semi").select("id", "v")
        partial = kept.count()
        compared = lists = materialize(_lists(fresh), "edges-fresh")  # read twice below, and what comparing moved goes here
        if partial:
            # A list is only touched where a changed vector beats its last entry, or it has room.
            offered = neighbours.top_k(others, arrived, LISTED).select("i", "j", "similarity").join(kept.select(F.col("id").alias("i"), F.size("near").alias("held"), F.element_at("near", -1).alias("last")), "i")
            rounded, last = F.round("similarity", 12), F.round("last.similarity", 12)
            better = (F.col("held") < LISTED) | (rounded > last) | ((rounded == last) & (F.col("j") < F.col("last.j")))
            offered = materialize(offered.where(better).select("i", "j", "similarity"), "edges-offered")
            moved = kept.join(offered.select(F.col("i").alias("id")).distinct(), "id", "left_semi")
            old = moved.select(F.col("id").alias("i"), F.explode("near").alias("x")).select("i", "x.j", "x.similarity")
            lists = lists.unionByName(_lists(old.unionByName(offered)))
        # A vector that has no other one beside it has an empty list.
        alone = whole.join(lists.select("id"), "id", "left_anti").select("id", F.array().cast("array<struct<similarity:double,j:long>>").alias("near"))
        rows = materialize(lists.unionByName(alone).join(now.select("id", "digest"), "id").select("id", "digest", "near"), "edges-rows")
        for read in (compared, now):
            discard(read)
        table.replace(removed, rows)
        return Update(whole.count(), partial, removed.count(), rows.count())


def routing_edges(table: KeyedTable, k: int | None = None) -> DataFrame:
    """As neighbours.routing_edges, from the table."""
    rows = table.read()
    k = k or neighbours.neighbours_for(rows.count())
    found = rows.select(F.col("id").alias("a"), F.explode(F.slice("near", 1, min(k, LISTED))).alias("x")).where(F.col("x.similarity") >= fixed.MIN_EDGE_SIMILARITY)
    found = found.select("a", F.col("x.j").alias("b"), (1 - F.col("x.similarity") + fixed.HOP_PENALTY).alias("distance"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    return both.groupBy("a", "b").agg(F.max("distance").alias("distance"))


def content_key(table: KeyedTable, model_id: str) -> tuple[str, int, int]:
    """What has to be unchanged for a graph made from the table to be right: the model, how many vectors, and a sum of their digests."""
    row = table.read().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id", "digest")), F.lit(0)).alias("x")).first()
    return model_id, row["n"], row["x"]
