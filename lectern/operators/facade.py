"""What a client asks of a library, each as one function that returns a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import catalog, neighbours, reading, search

#: Most rows of each answer.
SEARCH, SIMILAR, REGION_MEMBERS, REGION_TERMS, OVERVIEW_TAGS, CURRICULUM_HITS, QUANTITY_ROWS = 40, 25, 15, 8, 40, 40, 100


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def search_library(papers: DataFrame, mode: str, query: str, limit: int = 10, chunks: DataFrame | None = None, index: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """(id, title, score, snippet) by title, full text or meaning."""
    limit = clamp(limit, 1, SEARCH)
    if mode == "title":
        return search.search_titles(papers, query).limit(limit).select("id", "title", F.col("matches").cast("double").alias("score"), F.lit(None).cast("string").alias("snippet"))
    if mode == "fulltext":
        found = search.search_fulltext(chunks, index, papers, query, limit)
        return found.select(F.col("paper_id").alias("id"), "title", "score", "snippet")
    if mode == "semantic":
        found = neighbours.nearest(vectors, query_vector, limit)
        return found.join(papers.select("id", "title"), "id", "left").select("id", "title", F.round("similarity", 4).alias("score"), F.lit(None).cast("string").alias("snippet"))
    raise ValueError(f"no such mode: {mode}")


def get_paper(papers: DataFrame, paper_id: int, places: DataFrame | None = None, tags: DataFrame | None = None, readings: DataFrame | None = None) -> DataFrame:
    """Everything known of one paper: metadata, place, sorted tags, reading; each may be missing."""
    out = papers.where(F.col("id") == paper_id)
    if places is not None:
        out = out.join(places.where(F.col("id") == paper_id), "id", "left")
    if tags is not None:
        own = tags.where(F.col("paper_id") == paper_id).groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("slug")).alias("tags"))
        out = out.join(own, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if readings is not None:
        out = out.join(readings, "id", "left")
    return out


def read_paper(texts: DataFrame, paper_id: int, offset: int = 0, window: int = 4000) -> DataFrame:
    own = texts.where(F.col("id") == paper_id)
    return own.select("id", search.read_window(F.col("text"), F.lit(offset), F.lit(window)).alias("w")).select("id", "w.*")


def similar_papers(vectors: DataFrame, papers: DataFrame, paper_id: int, k: int = 5) -> DataFrame:
    row = vectors.where(F.col("id") == paper_id).select(F.col("v").cast("array<double>").alias("v")).first()
    if row is None:
        return papers.limit(0).select("id", "title", F.lit(0.0).alias("similarity"))
    found = neighbours.nearest(vectors, row["v"], clamp(k, 1, SIMILAR), [paper_id])
    return found.join(papers.select("id", "title"), "id", "left").select("id", "title", F.round("similarity", 4).alias("similarity"))


def anchor(vectors: DataFrame, query_vector: list[float]) -> int | None:
    """The paper nearest to a phrase."""
    row = neighbours.nearest(vectors, query_vector, 1).first()
    return None if row is None else row["id"]


def list_regions(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster", "label", "size", F.slice("terms", 1, REGION_TERMS).alias("terms")).orderBy(F.desc("size"), "cluster")


def first_author(authors: Column) -> Column:
    return F.get(tx.split_authors(authors), F.lit(0))


def region_members(members: DataFrame, papers: DataFrame, region: int, most: int = REGION_MEMBERS) -> DataFrame:
    """Members of a region, most representative first."""
    own = members.where(F.col("cluster") == region).join(papers.select("id", "title", "year", "authors"), "id", "left")
    rows = own.select("id", "title", "year", first_author(F.col("authors")).alias("first_author"), F.round("strength", 3).alias("confidence"))
    return rows.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.lower(F.coalesce("title", F.lit(""))), "id").limit(most)


def relationships(links: DataFrame, clusters: DataFrame, papers: DataFrame) -> DataFrame:
    """Links with the labels of both ends and the titles of the papers between, strongest first."""
    names = clusters.select("cluster", "label")
    rows = links.join(names.select(F.col("cluster").alias("source_id"), F.col("label").alias("source_label")), "source_id", "left")
    rows = rows.join(names.select(F.col("cluster").alias("target_id"), F.col("label").alias("target_label")), "target_id", "left")
    between = rows.select("source_id", "target_id", F.posexplode("paper_ids").alias("place", "id")).join(papers.select("id", "title"), "id", "left")
    titles = between.groupBy("source_id", "target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]).alias("titles"))
    return rows.join(titles, ["source_id", "target_id"], "left").orderBy(F.desc("similarity"), "source_id", "target_id")


def library_overview(papers: DataFrame, places: DataFrame, clusters: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: how many papers, how many on the map, how many regions, and up to forty tags."""
    slugs = tags.select("slug").distinct().orderBy("slug").limit(OVERVIEW_TAGS).agg(F.sort_array(F.collect_list("slug")).alias("tags"))
    counts = papers.agg(F.count(F.lit(1)).alias("papers")).crossJoin(places.agg(F.count(F.lit(1)).alias("on_map"))).crossJoin(clusters.agg(F.count(F.lit(1)).alias("regions")))
    return counts.crossJoin(slugs)  # single rows


def query_quantities(quantities: DataFrame, kind: str | None = None, unit: str | None = None, low: float | None = None, high: float | None = None, words: str | None = None, limit: int = 20) -> DataFrame:
    """Without any filter the kinds; else trusted rows by value, with the number of rows and papers before the limit."""
    if all(x is None for x in (kind, unit, low, high, words)):
        return catalog.quantity_kinds(quantities)
    rows = catalog.within(catalog.trusted(quantities), "value_si", low, high)
    if kind is not None:
        rows = rows.where(F.col("quantity_kind") == kind)
    if unit is not None:
        rows = catalog.with_unit(rows, unit)
    if words is not None:
        rows = catalog.phrase(rows, "context", words)
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("paper_id").alias("papers"))
    return rows.orderBy("value_si", "id").limit(clamp(limit, 1, QUANTITY_ROWS)).crossJoin(F.broadcast(totals))


def match_region(clusters: DataFrame, wanted: str) -> DataFrame:
    """The largest region whose name's words hold those asked for, or the other way round."""
    return clusters.where(catalog.region_matches(wanted, F.col("label"))).orderBy(F.desc("size"), "cluster").limit(1)


def get_curriculum(wanted: str, clusters: DataFrame, members: DataFrame, papers: DataFrame, vectors: DataFrame, query_vector: list[float] | None = None, dim: int = 64) -> DataFrame:
    """Where to begin in a region, or in what is nearest to a topic: scored papers with reasons and their step in the walk."""
    region = match_region(clusters, wanted).first()
    if region is not None:
        chosen = members.where(F.col("cluster") == region["cluster"]).select("id")
    elif query_vector is not None:
        chosen = neighbours.nearest(vectors, query_vector, CURRICULUM_HITS).select("id")
    else:
        chosen = members.limit(0).select("id")
    rows = papers.join(chosen, "id").where(tx.presentable(F.col("title"))).join(vectors.select("id", "v"), "id").withColumn("topic", F.lit(wanted))
    scored = reading.rank_entry_points(rows.select("topic", "id", "title", "abstract", "year", "pages", "v"), "topic", dim)
    walk = reading.reading_order(scored, "topic").select("id", F.col("step").alias("step"))
    return scored.drop("u").join(walk, "id", "left")


def adjudication_batches(quantities: DataFrame, size: int = 25) -> DataFrame:
    """Pending rows, numbered in batches that are settled and written one at a time."""
    from pyspark.sql import Window

    pending = quantities.where(F.col("status") == "pending_llm")
    place = F.row_number().over(Window.partitionBy("quantity_kind").orderBy("id")) - 1
    return pending.withColumn("batch", F.floor(place / size))


def outstanding_reviews(quantities: DataFrame, limit: int = 100) -> DataFrame:
    return quantities.where(F.col("status") == "pending_review").orderBy("id").limit(limit)


def review_writes(quantities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The table after people confirmed or rejected rows; another word is refused."""
    word = F.when(F.col("verdict").isin("confirmed", "rejected"), F.col("verdict")).otherwise(F.raise_error(F.lit("confirmed or rejected")))
    v = verdicts.select("id", word.alias("_v"))
    return quantities.join(v, "id", "left").withColumn("status", F.coalesce("_v", "status")).drop("_v")


def quarantine_report(findings: DataFrame, day: Column) -> DataFrame:
    """Where each file of the findings would go; nothing is moved."""
    name = F.element_at(F.split("path", "/"), -1)
    return findings.select("path", "problem", F.concat_ws("/", F.lit(".quarantine"), day, name).alias("target"), "keeper")
