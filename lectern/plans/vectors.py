"""Queries over document vectors: neighbours, graphs, bridges, layouts, reading orders, clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keyed import KeyedTable
from ..functions.tables import materialize, run_dir
from ..functions.vectors import norm, unit
from ..operators import bridges, cells, clustering, edges, maps, neighbours, reading, trails, umap
from .base import cte, library, query, table

V, P = "vectors", "papers"

#: Every pair with its cosine, in the SQL that checks.
PAIRS = """pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"""


def _vectors(spark, d):
    return library(spark, d, V)


@query("SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def v1_unit_vectors(spark, d):
    return _vectors(spark, d).select("id", F.round(norm(F.col("v")), 5).alias("norm"), F.round(unit(F.col("v"))[0], 5).alias("first"))


@query(
    f"""WITH {PAIRS}, t AS (SELECT j AS id, s, row_number() OVER (ORDER BY s DESC, j) AS r FROM pairs WHERE i = 0)
    SELECT id, round(s, 4) AS similarity, lang, source FROM t LEFT JOIN documents ON doc_id = id WHERE r <= 10"""
)
def v2_similar_to_one(spark, d):
    vectors = _vectors(spark, d)
    query_vector = [float(x) for x in vectors.where("id = 0").first()["v"]]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return neighbours.nearest(vectors, query_vector, 10, [0]).withColumn("similarity", F.round("similarity", 4)).join(docs, "id", "left")


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS r FROM pairs) SELECT i, j, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM t WHERE r <= 5")
def w2_top_k_per_row(spark, d):
    v = _vectors(spark, d)
    return neighbours.top_k(v, v, 5).select("i", "j", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS r FROM pairs) SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM t WHERE r <= 2 AND s >= 0.35")
def v4_skeleton(spark, d):
    return neighbours.skeleton(_vectors(spark, d))


ROUTING = f"""WITH {PAIRS}, k AS (SELECT least(greatest(5, least(60, round_even(least(count(*) / 8, sqrt(count(*))), 0))), count(*) - 1) AS k FROM embeddings),
    t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS r FROM pairs),
    e AS (SELECT i, j, (1 - s) + 0.05 AS distance FROM t, k WHERE r <= k AND s >= 0.35), b AS (SELECT i AS a, j AS b, distance FROM e UNION ALL SELECT j, i, distance FROM e)
    SELECT a, b, round(max(distance), 6) AS distance FROM b GROUP BY 1, 2"""


@query(ROUTING)
def v5_routing_edges(spark, d):
    return neighbours.routing_edges(_vectors(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS r FROM pairs) SELECT i, j, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM t WHERE r <= 10")
def v2_cells(spark, d):
    """Exact neighbours over cells, whatever the size."""
    v = _vectors(spark, d)
    index = cells.build(v, v.count())
    return cells.top_k(index, index, 10).select("i", "j", F.round("similarity", 6).alias("similarity"), "rank")


@query(ROUTING)
def v10_edge_table(spark, d):
    """The graph from a table of neighbours that follows the vectors: a first part, then a part of it turned, then all."""
    v = _vectors(spark, d)
    kept = KeyedTable(spark, f"{run_dir(spark)}/edges-{uuid.uuid4().hex}", "id")
    turned = F.when(F.col("cluster") == 1, F.reverse("v")).otherwise(F.col("v"))
    edges.update(kept, v.where("cluster <> 0").withColumn("v", turned))
    edges.update(kept, v)
    return edges.routing_edges(kept).select("a", "b", F.round("distance", 6).alias("distance"))


@query()
def v8_trails(spark, d):
    v = _vectors(spark, d)
    links = materialize(neighbours.routing_edges(v), "links")
    ends = spark.createDataFrame([(k, k, 100 + 3 * k) for k in range(12)] + [(12, 5, 5)], "trail long, start long, goal long")
    return trails.find_paths(links, v, ends)


@query(
    """WITH u AS (SELECT label, i, avg(embedding[i] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
    c AS (SELECT label, list(m ORDER BY i) AS v FROM u GROUP BY 1),
    p AS (SELECT a.label AS source_id, b.label AS target_id, a.v AS va, b.v AS vb, list_cosine_similarity(a.v, b.v) AS s FROM c a, c b WHERE a.label < b.label),
    f AS (SELECT greatest(0.05, quantile_cont(s, 0.6)) AS floor FROM p), n AS (SELECT p.* FROM p, f WHERE s >= floor),
    m AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE CAST(vec_id % 100 AS DOUBLE) / 100 <= 0.75),
    l AS (SELECT source_id, target_id, id, list_cosine_similarity(e, CASE WHEN label = source_id THEN vb ELSE va END) AS affinity FROM n JOIN m ON label IN (source_id, target_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY affinity DESC, id DESC) AS r FROM l WHERE affinity >= 0.1)
    SELECT n.source_id, n.target_id, round(n.s, 4) AS similarity, array_to_string(list(r.id ORDER BY r.r), ',') AS paper_ids FROM n JOIN r USING (source_id, target_id) WHERE r.r <= 6
    GROUP BY n.source_id, n.target_id, n.s ORDER BY n.s DESC, 1, 2 LIMIT 12"""
)
def c7_bridges(spark, d):
    found = bridges.find_bridges(_vectors(spark, d), min_similarity=0.05, min_affinity=0.1)
    return found.withColumn("paper_ids", F.array_join(F.transform("paper_ids", lambda x: x.cast("string")), ","))


@query("SELECT n AS rows, CASE WHEN n < 2 THEN 5 ELSE least(greatest(5, least(60, CAST(round_even(least(n / 8, sqrt(n)), 0) AS INTEGER))), n - 1) END AS neighbours, CASE WHEN n < 200 THEN 0.5 WHEN n < 1000 THEN 0.6 ELSE 0.7 END::DOUBLE AS share FROM (SELECT n_nationkey * n_nationkey * 7 AS n FROM nation)")
def c1_scale_rules(spark, d):
    sizes = [r[0] for r in table(spark, d, "nation").selectExpr("n_nationkey * n_nationkey * 7 AS n").collect()]  # twenty-five rows
    return spark.createDataFrame([(n, neighbours.neighbours_for(n), clustering.max_cluster_share(n)) for n in sizes], "rows int, neighbours int, share double")


@query()
def c6_density_clusters(spark, d):
    return clustering.cluster_vectors(_vectors(spark, d))


@query()
def c6_neighbourhood_clusters(spark, d):
    return clustering.cluster_vectors(_vectors(spark, d), by="umap")


@query()
def c6_kmeans(spark, d):
    return clustering.kmeans(_vectors(spark, d), 10)


@query(
    f"""WITH {PAIRS}, f AS (SELECT i, j, s FROM pairs JOIN embeddings ON vec_id = j WHERE label <> 0), t AS (SELECT i, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM f),
    near AS (SELECT i AS id, avg(1 - s) AS away FROM t JOIN embeddings ON vec_id = i WHERE r <= 15 AND label = 0 GROUP BY 1), own AS (SELECT i, avg(1 - s) AS away FROM t JOIN embeddings ON vec_id = i WHERE r <= 15 AND label <> 0 GROUP BY 1),
    b AS (SELECT greatest(quantile_cont(away, 0.5), 1e-6) AS base FROM own) SELECT id, round(away / base, 5) AS drift FROM near, b"""
)
def m3_drift(spark, d):
    v = _vectors(spark, d)
    return neighbours.drift(v.where("cluster = 0"), v.where("cluster <> 0")).select("id", F.round("drift", 5).alias("drift"))


@query()
def m1_projection(spark, d):
    v = _vectors(spark, d)
    mean, components = maps.fit_pca(v.where("cluster <> 0"), 64)
    return maps.project(v, mean, components).select("id", *[F.round(c, 5).alias(c) for c in "xyz"])


@query()
def m1_umap_layout(spark, d):
    """All vectors but those of cluster 0 are laid out; these are placed among them (M2)."""
    v = _vectors(spark, d)
    fitted, new = v.where("cluster <> 0"), v.where("cluster = 0")
    places = umap.layout(fitted)
    every = places.withColumn("placed", F.lit(False)).unionByName(umap.place(new, fitted, places).withColumn("placed", F.lit(True)))
    return every.select("id", *[F.round(F.col("p")[k], 5).alias(c) for k, c in enumerate("xyz")], "placed")


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y, round(embedding[3]::DOUBLE, 4) AS z FROM embeddings")
def m4_procrustes(spark, d):
    # A layout turned by 90 degrees, mirrored, scaled and moved comes back to where it was.
    base = table(spark, d, "embeddings").selectExpr("vec_id AS id", "label", *[f"CAST(embedding[{k}] AS DOUBLE) AS {c}" for k, c in enumerate("xyz")])
    moved = base.select("id", (F.col("y") * 3 + 1).alias("x"), (F.col("x") * 3 - 2).alias("y"), (F.col("z") * -3).alias("z"))
    return maps.align(moved, base.where("label < 3")).select("id", *[F.round(c, 4).alias(c) for c in "xyz"])


LAYOUT = "l AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _layout(spark, d, shift=0):
    return table(spark, d, "embeddings").selectExpr("vec_id AS id", "label", *[f"CAST(embedding[{k + shift}] AS DOUBLE) AS {c}" for k, c in enumerate("xyz")])


@query(
    f"""WITH {LAYOUT}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM l),
    r AS (SELECT id, x - cx AS x, y - cy AS y, z - cz AS z, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM l, c),
    o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM r), s AS (SELECT 40 / r AS scale FROM o, c WHERE k = least(n - 1, floor(n * 0.9)))
    SELECT id, round(x * scale, 5) AS x, round(y * scale, 5) AS y, round(z * scale, 5) AS z FROM r, s"""
)
def m7_normalised_layout(spark, d):
    return maps.normalise(_layout(spark, d)).select("id", *[F.round(c, 5).alias(c) for c in "xyz"])


@query(
    f"""WITH {LAYOUT}, t AS (SELECT vec_id AS id, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings WHERE label < 5)
    SELECT l.id, round(l.x * 0.75 + coalesce(t.x, l.x) * 0.25, 6) AS x, round(l.y * 0.75 + coalesce(t.y, l.y) * 0.25, 6) AS y, round(l.z * 0.75 + coalesce(t.z, l.z) * 0.25, 6) AS z FROM l LEFT JOIN t USING (id)"""
)
def m8_morph(spark, d):
    return maps.morph(_layout(spark, d), _layout(spark, d, 3).where("label < 5"), 0.25).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(cte(P) + "SELECT id, round(0.62 + 0.78 * least(ln(greatest(coalesce(pages, 12), 1) + 1) / ln(21), 1.9), 6) AS size, CASE WHEN id % 4 = 0 THEN round(1 + least(coalesce(confidence, 0) * 5, 3) * 0.35, 6) ELSE 1.0 END AS halo FROM papers")
def m9_node_size(spark, d):
    p = library(spark, d, P)
    halo = maps.provisional_halo(F.col("id") % 4 == 0, F.coalesce("confidence", F.lit(0.0)) * 5)
    return p.select("id", F.round(maps.node_size(F.col("pages")), 6).alias("size"), F.round(halo, 6).alias("halo"))


def _candidates(spark, d):
    """Papers with vectors; every ninth title announces an introduction, every eighth abstract a survey."""
    p = library(spark, d, P).select("id", "abstract", "year", "pages", F.coalesce("title", F.lit("")).alias("title"))
    title = F.when(F.col("id") % 9 == 0, F.concat(F.lit("A Survey of "), "title")).otherwise(F.col("title"))
    abstract = F.when(F.col("id") % 8 == 0, F.concat(F.lit("Here we review "), "abstract")).otherwise(F.col("abstract"))
    return p.select("id", title.alias("title"), abstract.alias("abstract"), "year", "pages").join(_vectors(spark, d), "id")


ENTRY = (
    cte(P)
    + """, c AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'A Survey of ' || coalesce(title, '') ELSE coalesce(title, '') END AS title, CASE WHEN id % 8 = 0 THEN 'Here we review ' || abstract ELSE abstract END AS abstract,
      year, pages, label AS cluster, embedding::DOUBLE[] AS e FROM papers JOIN embeddings ON vec_id = id),
    u AS (SELECT cluster, i, avg(e[i] / sqrt(list_inner_product(e, e))) AS m FROM c, range(1, 65) r(i) GROUP BY 1, 2), k AS (SELECT cluster, list(m ORDER BY i) AS v FROM u GROUP BY 1),
    s AS (SELECT c.*, round(list_cosine_similarity(e, v), 12) AS raw, CASE WHEN regexp_matches(title, '\\b(survey|introduction)\\b', 'i') THEN 1.0 WHEN regexp_matches(substr(abstract, 1, 600), '\\bwe review\\b', 'i') THEN 0.5 ELSE 0.0 END AS intro,
      min(year) OVER w AS y0, max(year) OVER w AS y1 FROM c JOIN k USING (cluster) WINDOW w AS (PARTITION BY cluster)),
    t AS (SELECT *, 1 - percent_rank() OVER (PARTITION BY cluster ORDER BY raw DESC) AS rs, CASE WHEN y0 < y1 AND year IS NOT NULL THEN 1 - (year - y0) / (y1 - y0) ELSE 0.5 END AS ys,
      CASE WHEN pages IS NULL THEN 0.5 WHEN pages <= 30 THEN 1 WHEN pages >= 300 THEN 0 ELSE 1 - (pages - 30) / 270.0::DOUBLE END AS ls FROM s),
    f AS (SELECT *, round_even(0.45 * rs + 0.30 * intro + 0.15 * ys + 0.10 * ls, 4) AS score, round_even(raw, 4) AS centrality FROM t),
    """
)


@query(
    ENTRY
    + """o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, centrality DESC, year NULLS LAST, id) AS place FROM f)
    SELECT cluster, id, score::DOUBLE AS score, centrality, CAST(place AS INTEGER) AS place FROM o"""
)
def r1_entry_points(spark, d):
    return reading.rank_entry_points(_candidates(spark, d)).select("cluster", "id", "score", "centrality", "place")


@query(cte(P) + ", c AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'A Survey of ' || coalesce(title, '') ELSE coalesce(title, '') END AS title FROM papers) SELECT id, CASE WHEN regexp_matches(title, '\\bsurvey\\b', 'i') THEN 1.0 ELSE 0.0 END::DOUBLE AS strength, CASE WHEN regexp_matches(title, '\\bsurvey\\b', 'i') THEN 'survey' END AS cue FROM c")
def r2_intro_cue(spark, d):
    p = library(spark, d, P)
    title = F.when(F.col("id") % 9 == 0, F.concat(F.lit("A Survey of "), F.coalesce("title", F.lit("")))).otherwise(F.coalesce("title", F.lit("")))
    strength, cue = reading.intro_cue(title, F.lit(None).cast("string"))
    return p.select("id", strength.alias("strength"), cue.alias("cue"))


@query(
    ENTRY
    + """o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, centrality DESC, year NULLS LAST, id) AS place FROM f)
    SELECT id, len(list_filter([rs >= 0.5, intro >= 0.5, y0 < y1 AND year IS NOT NULL AND ys >= 0.5, pages IS NOT NULL AND ls >= 0.5], lambda x: x))::INTEGER AS n, CASE WHEN rs >= 1 THEN 'closest to the centre of this region' WHEN rs >= 0.5 THEN 'near the centre of this region' END AS first
    FROM o WHERE rs >= 0.5"""
)
def r5_reasons(spark, d):
    scored = reading.rank_entry_points(_candidates(spark, d)).where(F.get("reasons", F.lit(0)).rlike("centre of this region"))
    return scored.select("id", F.size("reasons").alias("n"), F.get("reasons", F.lit(0)).alias("first"))


@query()
def r6_reading_order(spark, d):
    return reading.reading_order(reading.rank_entry_points(_candidates(spark, d)))


@query()
def r7_curriculum(spark, d):
    return reading.curriculum(_candidates(spark, d)).select("cluster", "id", "title", "score", "reasons", "place")


@query(
    f"""WITH {PAIRS}, s AS (SELECT event_type AS trail, event_id AS place, user_id % 400 AS id FROM events), n AS (SELECT trail, place, id, lead(id) OVER (PARTITION BY trail ORDER BY place) AS next_id FROM s)
    SELECT trail, place, id, next_id, round(p.s, 6) AS similarity FROM n LEFT JOIN pairs p ON p.i = id AND p.j = next_id"""
)
def w4_similarity_to_next(spark, d):
    from pyspark.sql import Window

    from ..functions.vectors import dot

    stops = table(spark, d, "events").select(F.col("event_type").alias("trail"), F.col("event_id").alias("place"), (F.col("user_id") % 400).alias("id"))
    stops = stops.withColumn("next_id", F.lead("id").over(Window.partitionBy("trail").orderBy("place")))
    v = _vectors(spark, d).select("id", unit(F.col("v")).alias("u"))
    joined = stops.join(v, "id", "left").join(v.select(F.col("id").alias("next_id"), F.col("u").alias("w")), "next_id", "left")
    similarity = F.when(F.col("id") != F.col("next_id"), F.round(dot(F.col("u"), F.col("w")), 6))
    return joined.select("trail", "place", "id", "next_id", similarity.alias("similarity"))


@query("SELECT n, array_to_string(list(CAST(p AS VARCHAR) ORDER BY p), ',') AS places FROM (SELECT DISTINCT n, CAST(round_even(k * (n - 1) / 13, 0) AS BIGINT) AS p FROM (SELECT n_nationkey + 15 AS n FROM nation), range(14) r(k)) GROUP BY 1")
def w7_thin(spark, d):
    stops = F.sequence(F.lit(0).cast("long"), F.col("n_nationkey") + 14)
    return table(spark, d, "nation").select((F.col("n_nationkey") + 15).alias("n"), F.array_join(trails.thinned(stops).cast("array<string>"), ",").alias("places"))
