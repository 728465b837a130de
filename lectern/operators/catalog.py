"""Relational operators of the library: filters, joins, summaries, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.keyed import KeyedTable
from ..functions.partitions import indexed

# --- filters --------------------------------------------------------------------


def list_papers(papers: DataFrame, q: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of papers, newest first, with the number of all that match; % and _ in q are wildcards."""
    found = papers
    if status is not None:
        found = found.where(F.col("status") == status)
    if q is not None:
        found = found.where(F.col("title").ilike(f"%{q}%") | F.col("doi").ilike(f"%{q}%"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def trusted(quantities: DataFrame) -> DataFrame:
    return quantities.where(F.col("status").isin(*fixed.TRUSTED_QUANTITY_STATUSES) & F.col("value_si").isNotNull())


def within(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive bounds, each optional."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def with_unit(quantities: DataFrame, unit: str) -> DataFrame:
    wanted = unit.lower()
    return quantities.where((F.lower("unit_original") == wanted) | (F.lower("unit_si") == wanted))


def phrase(df: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose text contains the words as written, in any case; nothing in them is a wildcard."""
    return df.where(F.contains(F.lower(column), F.lit(words.lower())))


def kind_for_unit(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, kind): the exact token, else a token in another case (the first), else the family's own unit."""
    w, u = wanted.select("unit").distinct(), F.broadcast(units)  # the unit table: under a hundred rows
    exact = w.join(u, w["unit"] == u["token"]).select(w["unit"], "kind", F.lit(0).alias("rank"), "place")
    folded = w.join(u, F.lower(w["unit"]) == F.lower(u["token"])).select(w["unit"], "kind", F.lit(1).alias("rank"), "place")
    named = w.join(u, F.lower(w["unit"]) == F.lower(u["unit_si"])).select(w["unit"], "kind", F.lit(2).alias("rank"), "place")
    best = exact.unionByName(folded).unionByName(named).groupBy("unit").agg(F.min_by("kind", F.struct("rank", "place")).alias("kind"))
    return w.join(best, "unit", "left")


def outstanding(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs of the same kind and paper (both null counts as same) that still wait or run."""
    active = jobs.where(F.col("state").isin("queued", "running"))
    return active.join(wanted.select(F.col("kind").alias("k"), F.col("paper_id").alias("p")), (F.col("kind") == F.col("k")) & F.col("paper_id").eqNullSafe(F.col("p")), "left_semi")


def visible(nodes: DataFrame, hits: DataFrame | None = None, tags: DataFrame | None = None, active_tags: list[str] | None = None, cutoff: int | None = None, measured: DataFrame | None = None) -> DataFrame:
    """Nodes that every active filter lets through; an unknown year passes any cutoff."""
    if hits is not None:
        nodes = nodes.join(hits.select("id").distinct(), "id", "left_semi")
    if active_tags:
        tagged = tags.where(F.col("slug").isin(*active_tags)).select(F.col("paper_id").alias("id")).distinct()
        nodes = nodes.join(tagged, "id", "left_semi")
    if cutoff is not None:
        nodes = nodes.where(F.col("year").isNull() | (F.col("year") <= cutoff))
    if measured is not None:
        nodes = nodes.join(measured.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
    return nodes


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def region_matches(wanted: str, label: Column) -> Column:
    """Whether one set of words holds the other."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    a, b = words(F.lit(wanted)), words(label)
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def bridges_from(links: DataFrame, region: int) -> DataFrame:
    """Links of one region, seen from it, strongest first."""
    here = F.col("source_id") == region
    seen = links.where(here | (F.col("target_id") == region))
    return seen.select(F.when(here, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"), "similarity").orderBy(F.desc("similarity"), "other_id")


#: Failures of the document itself, which a further try can't mend; and of the machine, which a repair can.
FATAL_TYPES = ("FatalDocument", "FileNotFoundError", "IsADirectoryError", "FileDataError", "EmptyFileError")
MACHINE_MARKS = ("No module named 'sentence_transformers'", "No module named 'torch'", "No module named 'marker'")


def failure_class(error: Column) -> Column:
    """fatal, if the error's type says that the document is the obstacle; else transient."""
    kind = F.element_at(F.split(F.regexp_extract(F.coalesce(error, F.lit("")), r"^([\w.]+)(?::|$)", 1), r"\."), -1)
    return F.when(kind.isin(*FATAL_TYPES), "fatal").otherwise("transient")


def revivable(jobs: DataFrame) -> DataFrame:
    """Dead jobs that the machine failed, not the document."""
    hit = F.lit(False)
    for mark in MACHINE_MARKS:
        hit = hit | F.contains(F.coalesce("last_error", F.lit("")), F.lit(mark))
    return jobs.where((F.col("state") == "dead") & hit)


# --- joins -----------------------------------------------------------------------


def map_nodes(placed: DataFrame, papers: DataFrame, run_id: int) -> DataFrame:
    """Placements of one run with what is known of each paper, which may be nothing."""
    own = placed.where(F.col("run_id") == run_id)
    return own.join(papers.withColumnRenamed("id", "paper_id"), "paper_id", "left").orderBy("paper_id")


def describe_stops(stops: DataFrame, papers: DataFrame, placed: DataFrame, clusters: DataFrame, run_id: int) -> DataFrame:
    """Stops of a trail with title, place in the given run and cluster; none of these need exist."""
    p = papers.select(F.col("id").alias("paper_id"), "title", "year")
    q = placed.select(F.col("paper_id").alias("placed_id"), "run_id", "x", "y", "z", "cluster_id")
    joined = stops.join(p, "paper_id", "left").join(q, (F.col("paper_id") == F.col("placed_id")) & (F.col("run_id") == run_id), "left")
    return joined.join(clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id", "left").select("place", "paper_id", "title", "year", "x", "y", "z", "cluster_id", "label")


def resolve_tags(tags: DataFrame) -> DataFrame:
    """Each tag with the one it stands for: one step along its alias, no further."""
    to = tags.select(F.col("id").alias("canonical_id"), F.col("slug").alias("canonical_slug"))
    return tags.join(to, "canonical_id", "left").select("id", "slug", F.coalesce("canonical_id", "id").alias("resolved_id"), F.coalesce("canonical_slug", "slug").alias("resolved_slug"))


def duplicate_works(papers: DataFrame, key: str) -> DataFrame:
    """Papers whose key others share, with the least id of those; keys that only one has are left out.

    Grouped rather than joined with itself: a key of many copies gives one row each.
    """
    shared = papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return papers.join(shared, key).select("id", key, "first_id", "copies")


def trail_indices(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stops that are on the map, in trail order, with their index there; the last hop is marked as the jump of an incomplete trail."""
    last = F.max("place").over(Window.partitionBy("trail"))
    return stops.withColumn("is_jump", (F.col("place") == last) & ~F.col("complete")).join(nodes.select(F.col("id").alias("paper_id"), "node_index"), "paper_id")


def models_overview(catalog: DataFrame, found: DataFrame, budget: float) -> DataFrame:
    """Every known or discovered model: listed or not, present or not, and whether it fits the budget."""
    both = catalog.withColumn("in_catalog", F.lit(True)).join(found.withColumn("discovered", F.lit(True)), "name", "full")
    return both.select("name", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"), F.coalesce("discovered", F.lit(False)).alias("discovered"), (F.coalesce("size", F.lit(0.0)) <= budget).alias("fits"))


# --- summaries -------------------------------------------------------------------


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def quantity_kinds(quantities: DataFrame) -> DataFrame:
    """Trusted rows by kind: number, least and greatest value, and the unit, most frequent kind first."""
    found = trusted(quantities).groupBy("quantity_kind").agg(F.count(F.lit(1)).alias("n"), F.min("value_si").alias("low"), F.max("value_si").alias("high"), F.min("unit_si").alias("unit_si"))
    return found.orderBy(F.desc("n"), "quantity_kind")


def corpus_counts(papers: DataFrame) -> DataFrame:
    """All scalar counts in one pass."""
    return papers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.countDistinct("source").alias("sources"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def should_refit(placed: DataFrame) -> DataFrame:
    """Whether too many placements were only transformed, or have drifted."""
    counts = placed.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_transformed").alias("transformed"), F.count_if(F.col("off_manifold") > fixed.DRIFT_LIMIT).alias("drifted"))
    share = F.col("transformed") / F.greatest("n", F.lit(1))
    return counts.select("*", ((share > fixed.REFIT_SHARE) | (F.col("drifted") >= fixed.REFIT_DRIFTED)).alias("refit"))


def top_terms(titles: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """Most frequent words of titles per key: of more than three letters or digits, not a number, not common; ties by first appearance.

    Input has ``keys``, ``ord`` (the order of titles) and ``title``.
    """
    words = F.transform(F.split(F.replace(F.lower("title"), F.lit("-"), F.lit(" ")), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    rows = titles.select(*keys, "ord", F.posexplode(words).alias("pos", "term"))
    rows = rows.where((F.length("term") > 3) & ~F.col("term").isin(*fixed.TITLE_STOPWORDS) & ~F.col("term").rlike(r"^\p{Nd}+$"))
    counted = rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select(*keys, "term", "n", "rank")


def topic_terms(texts: DataFrame, key: str, limit: int = 40) -> DataFrame:
    """A document's most frequent words of four letters and more, function words left out; ties by first appearance.

    Texts are dealt by document first: a text is far less than its words, each with its document and counts, and nothing moves after that.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nl}\p{No}]{4,})"), F.lit(1))
    rows = texts.repartition(key).select(key, F.posexplode(words).alias("pos", "term")).where(~F.col("term").isin(*fixed.STOPWORDS))
    counted = rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select(key, "term", "n", "rank")


def clustering_scores(rows: DataFrame, drop_noise: bool = False) -> DataFrame:
    """Agreement of ``cluster`` (-1: noise) with ``truth``: ARI, homogeneity, completeness, V-measure, purity, noise share.

    Everything follows from the contingency table; only that is gathered.
    """
    noise = rows.agg((F.count_if(F.col("cluster") == -1) / F.count(F.lit(1))).alias("noise_share"))
    used = rows.where("cluster <> -1") if drop_noise else rows
    cells = used.groupBy("truth", "cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: c * (c - 1) / 2.0
    entropy = lambda c: -F.sum(c / F.col("total") * F.ln(c / F.col("total")))
    total = cells.agg(F.sum("n").alias("total"))
    with_total = lambda df: df.crossJoin(F.broadcast(total))  # noqa: E731  one row
    a = with_total(cells.groupBy("truth").agg(F.sum("n").alias("n"))).agg(F.sum(pairs(F.col("n"))).alias("pairs_truth"), entropy(F.col("n")).alias("h_truth"))
    b = with_total(cells.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("most"))).agg(F.sum(pairs(F.col("n"))).alias("pairs_cluster"), entropy(F.col("n")).alias("h_cluster"), (F.sum("most") / F.max("total")).alias("purity"))
    both = with_total(cells).agg(F.sum(pairs(F.col("n"))).alias("pairs_both"), entropy(F.col("n")).alias("h_both"), F.max("total").alias("total"))
    t = both.crossJoin(a).crossJoin(b).crossJoin(noise)  # single rows
    expected = F.col("pairs_truth") * F.col("pairs_cluster") / pairs(F.col("total"))
    top = (F.col("pairs_truth") + F.col("pairs_cluster")) / 2 - expected
    ari = F.when(F.abs(top) < 1e-12, F.lit(1.0)).otherwise((F.col("pairs_both") - expected) / top)
    mutual = F.col("h_truth") + F.col("h_cluster") - F.col("h_both")
    homogeneity = F.when(F.col("h_truth") < 1e-12, F.lit(1.0)).otherwise(mutual / F.col("h_truth"))
    completeness = F.when(F.col("h_cluster") < 1e-12, F.lit(1.0)).otherwise(mutual / F.col("h_cluster"))
    v = F.when(homogeneity + completeness < 1e-12, F.lit(0.0)).otherwise(2 * homogeneity * completeness / (homogeneity + completeness))
    return t.select(F.round(ari, 4).alias("ari"), F.round(homogeneity, 4).alias("homogeneity"), F.round(completeness, 4).alias("completeness"), F.round(v, 4).alias("v_measure"), F.round("purity", 4).alias("purity"), F.round("noise_share", 4).alias("noise_share"))


def tag_vocabulary(paper_tags: DataFrame) -> DataFrame:
    """Per paper the sorted numbers of its tags in the sorted vocabulary."""
    slugs = paper_tags.select("slug").distinct()
    numbered = indexed(slugs, "slug", name="tag_id").select("slug", F.col("tag_id").cast("int").alias("tag_id"))
    pairs = paper_tags.select("paper_id", "slug").distinct().join(numbered, "slug")
    return pairs.groupBy("paper_id").agg(F.sort_array(F.collect_list("tag_id")).alias("tag_ids"))


def frame_for(nodes: DataFrame) -> DataFrame:
    """Centre of a set of points, and the camera's distance from it."""
    centre = nodes.agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    away = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return nodes.crossJoin(F.broadcast(centre)).groupBy("cx", "cy", "cz").agg(F.max(away).alias("radius")).withColumn("distance", F.greatest(F.lit(14.0), F.least(F.lit(120.0), F.col("radius") * 2.2 + 14)))


def mean_displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean distance moved by points of both layouts."""
    b, a = before.select("id", *[F.col(c).alias(f"b{c}") for c in "xyz"]), after.select("id", "x", "y", "z")
    moved = F.sqrt(sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg(moved), 6).alias("displacement"))


def upload_summary(files: DataFrame) -> DataFrame:
    """Per batch of twenty files: how many were accepted, and the names of the others in order."""
    rows = files.withColumn("batch", F.floor((F.col("place") - 1) / 20))
    rejected = F.sort_array(F.collect_list(F.when(~F.col("accepted"), F.struct("place", "name"))))
    return rows.groupBy("batch").agg(F.count_if("accepted").alias("accepted"), F.transform(rejected, lambda x: x["name"]).alias("rejected"))


# --- windows and rankings ----------------------------------------------------------


def rank_share(column: str, keys: list[str] | None = None) -> Column:
    """1 for the largest, 0 for the smallest; ties share, one value alone is 1."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return 1 - F.percent_rank().over(w.orderBy(F.desc(column)))


def best_per_paper(hits: DataFrame, limit: int) -> DataFrame:
    """The best hit of each paper among the first 3 * limit hits, at most ``limit`` papers."""
    cut = hits.orderBy(F.desc("score"), "chunk_id").limit(3 * limit)
    first = Window.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id")
    return cut.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").orderBy(F.desc("score"), "chunk_id").limit(limit)


def spread_sample(rows: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows per key, evenly spaced, in order; all of them where they are no more."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.col("_n") / limit
    # Row i is taken if some k has floor(k * n / limit) = i.
    k = F.ceil(F.col("_i") / step)
    taken = (F.col("_n") <= limit) | ((k < limit) & (F.floor(k * step) == F.col("_i")))
    return numbered.where(taken).drop("_i", "_n")


def page_runs(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages that are read in the same mode: (doc, mode, first_page, last_page)."""
    w = Window.partitionBy("doc").orderBy("page")
    change = F.coalesce((F.col("mode") != F.lag("mode").over(w)).cast("int"), F.lit(0))
    runs = pages.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return runs.groupBy("doc", "run", "mode").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def regions_crossed(stops: DataFrame) -> DataFrame:
    """Labels along each trail, repeats in a row once, unknown ones skipped."""
    known = stops.where(F.col("label").isNotNull())
    before = F.lag("label").over(Window.partitionBy("trail").orderBy("place"))
    kept = known.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("label")))
    return kept.groupBy("trail").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("regions"))


def bridge_weights(links: DataFrame, limit: int = 10) -> DataFrame:
    """The strongest links with a drawing weight from 0.35 to 1; equal ones all weigh 1."""
    drawn = links.orderBy(F.desc("similarity"), "source_id", "target_id").limit(limit)
    w = Window.partitionBy(F.lit(0))  # at most ``limit`` rows
    low, span = F.min("similarity").over(w), F.max("similarity").over(w) - F.min("similarity").over(w)
    return drawn.withColumn("weight", F.when(span > 1e-6, 0.35 + 0.65 * (F.col("similarity") - low) / span).otherwise(F.lit(1.0)))


def sort_papers(papers: DataFrame, key: str, ascending: bool = True) -> list[Column]:
    """Sort columns of the paper list: unknown values last in both directions, then the title."""
    first = F.asc_nulls_last(key) if ascending else F.desc_nulls_last(key)
    return [first, F.asc_nulls_last("title"), F.asc("id")]


def next_job(jobs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The job to claim: queued, of the given kinds, of least priority number, then oldest."""
    found = jobs.where(F.col("state") == "queued")
    if kinds:
        found = found.where(F.col("kind").isin(*kinds))
    return found.orderBy("priority", "id").limit(1)


def semantic_limit(count: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(12), F.round(2 * F.sqrt(F.greatest(count, F.lit(0)))))).cast("int")


def shared_terms(left: Column, right: Column, limit: int = 8) -> Column:
    return F.slice(F.filter(left, lambda x: F.array_contains(right, x)), 1, limit)


# --- library upkeep ------------------------------------------------------------------


def inspect_library(files: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Findings over (path, size, digest): empty files, and copies with the one that stays.

    Of copies the registered one stays, else the one fewest folders deep, then the first by name.
    Digests are compared within equal sizes only.
    """
    depth = F.size(F.split("path", "/"))
    known = files.join(registered.select("path", F.lit(True).alias("known")), "path", "left") if registered is not None else files.withColumn("known", F.lit(None).cast("boolean"))
    known = known.withColumn("rank", F.struct(F.coalesce(~F.col("known"), F.lit(True)).alias("fresh"), depth.alias("depth"), F.col("path")))
    some = known.where("size > 0")
    keepers = some.groupBy("size", "digest").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = some.join(keepers, ["size", "digest"]).where(F.col("rank") != F.col("best"))
    duplicates = copies.select("path", F.lit("duplicate").alias("problem"), F.col("best.path").alias("keeper"))
    empty = known.where("size = 0").select("path", F.lit("empty").alias("problem"), F.lit(None).cast("string").alias("keeper"))
    return duplicates.unionByName(empty)


def plan_fetch(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What to do with each file: fetch, present, changed, or extra (not wanted)."""
    w, p = wanted.select("file", F.col("digest").alias("want")), present.select("file", F.col("digest").alias("have"))
    action = F.when(F.col("have").isNull(), "fetch").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("have"), "present").otherwise("changed")
    return w.join(p, "file", "full").select("file", action.alias("action"))


def upsert_vectors(store: DataFrame, fresh: DataFrame, model_id: str, dim: int) -> DataFrame:
    """Replaces vectors of ids that come again; vectors of another model or length are refused."""
    right = (F.col("model_id") == model_id) & (F.size("v") == dim)
    checked = fresh.withColumn("v", F.when(right, F.col("v")).otherwise(F.raise_error(F.lit("a vector of another model or length"))))
    return store.join(checked.select("id"), "id", "left_anti").unionByName(checked)


def write_vectors(table: KeyedTable, fresh: DataFrame, model_id: str, dim: int) -> list[int]:
    """As upsert_vectors, into a table by id: the buckets that the ids fall into are written anew, all others keep their files.

    A vector of another model or length fails the write, which is then not seen.  Of rows that repeat an id in one write one stands.
    """
    right = (F.col("model_id") == model_id) & (F.size("v") == dim)
    return table.upsert(fresh.dropDuplicates(["id"]).withColumn("v", F.when(right, F.col("v")).otherwise(F.raise_error(F.lit("a vector of another model or length")))))


def keep_latest(events: DataFrame, key: str, order: str, most: int = 256) -> DataFrame:
    """The last ``most`` events of each subscriber; older ones are dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("event_id"))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def first_by_name(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Of names that differ in case alone, the first."""
    w = Window.partitionBy(*keys, F.lower(name)).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def work_keys(papers: DataFrame) -> DataFrame:
    author = F.element_at(tx.split_authors(F.col("authors")), 1)
    return papers.withColumn("work_key", tx.work_key(F.col("doi"), F.col("arxiv_id"), F.col("title"), author, F.sha2(F.col("path"), 256)))
