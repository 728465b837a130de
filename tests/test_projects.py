"""The map's life: first fit, placing, refit, one active run; encoders; facade answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import encode, facade, projects
from tests.test_vectors import blobs, frame


def test_map_life(spark, tmp_path):
    matrix, truth = blobs(3, 20)
    vectors = frame(spark, matrix)
    titles = spark.createDataFrame([(k, f"topic{truth[k]} words number") for k in range(60)], "id long, title string")
    store = projects.MapStore(spark, str(tmp_path / "map"))
    first = projects.project_corpus(store, vectors.where("id < 52"), titles, 16)
    assert first.refitted and store.active() == 0 and first.clusters == 3
    before = {r.id: (r.x, r.y, r.z) for r in store.read(0, "places").collect()}
    terms = {t for r in store.read(0, "clusters").collect() for t in r.terms}
    assert {"topic0", "topic1", "topic2"} <= terms

    placed = projects.project_corpus(store, vectors.where("id < 56"), titles, 16)
    assert not placed.refitted and placed.placed == 4 and store.active() == 0
    after = {r.id: (r.x, r.y, r.z) for r in store.read(0, "places").collect()}
    assert len(after) == 56 and all(after[k] == before[k] for k in before)

    refit = projects.project_corpus(store, vectors, titles, 16, force=True)
    assert refit.refitted and store.active() == 1 and store.read(1, "places").count() == 60
    span = np.ptp(np.array(list(before.values())), axis=0).max()
    assert refit.displacement < 0.1 * span

    other = projects.alternative_run(store, frame(spark, matrix[:, ::-1].copy()), 16)
    assert not other.refitted and store.active() == 1 and other.displacement < 0.2 * span

    papers = titles.selectExpr("id", "title", "2000 AS year", "10 AS pages")
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b")], "paper_id long, slug string")
    nodes, etag = projects.graph_payload(store, papers, tags)
    rows = {r.id: r for r in nodes.collect()}
    assert etag.startswith('W/"run-1-60-s') and rows[1].tags == [0, 1] and rows[5].tags == [] and len(rows[0].position) == 3
    assert sorted(r.node_index for r in rows.values()) == list(range(60))


def test_map_by_neighbourhoods(spark, tmp_path):
    """Twelve groups that PCA can't tell apart on three axes: found as clusters, and new vectors land beside their own group."""
    matrix, truth = blobs(groups=12, each=14, dim=32, spread=2.0, seed=6)
    new = np.arange(len(matrix)) % 14 == 3
    vectors = frame(spark, matrix)
    titles = spark.createDataFrame([(k, f"topic{truth[k]} number") for k in range(len(matrix))], "id long, title string")
    store = projects.MapStore(spark, str(tmp_path / "map"))
    first = projects.project_corpus(store, vectors.where("id % 14 <> 3"), titles, 32, method="neighbourhoods", layout="umap")
    assert first.refitted and first.clusters == 12
    members = {r.id: r.cluster for r in store.read(0, "members").collect()}
    pairs = [(a, b) for a in members for b in members if a < b]
    same = np.mean([(members[a] == members[b]) == (truth[a] == truth[b]) for a, b in pairs if min(members[a], members[b]) >= 0])
    assert same > 0.99 and np.mean([c >= 0 for c in members.values()]) > 0.9
    placed = projects.project_corpus(store, vectors, titles, 32)
    assert not placed.refitted and placed.placed == int(new.sum())
    rows = store.read(0, "places").orderBy("id").collect()
    at = np.array([(r.x, r.y, r.z) for r in rows])
    centres = np.array([at[(truth == g) & ~new].mean(axis=0) for g in range(12)])
    own = np.linalg.norm(at[new][:, None] - centres[None], axis=2).argmin(axis=1)
    assert (own == truth[new]).mean() >= 0.9
    with pytest.raises(ValueError, match="layout"):
        projects.project_corpus(store, vectors, titles, 32, layout="other")


def test_links_of_k_means_clusters(spark):
    rng = np.random.default_rng(5)
    shared = np.ones(16) * 0.6
    matrix = np.concatenate([shared + side * np.eye(16)[0] + rng.normal(size=(12, 16)) * 0.25 for side in (1, -1)])
    vectors, titles = frame(spark, matrix), spark.createDataFrame([(k, f"paper number{k}") for k in range(24)], "id long, title string")
    members, clusters = (df.cache() for df in projects.write_clusters(vectors, titles, 16, "k-means"))
    strength = [r.strength for r in members.collect()]
    assert {r.method for r in clusters.collect()} == {"k-means"} and len(strength) == 24
    assert 0 <= min(strength) < max(strength) <= 1 and min(strength) <= 0.75
    links = projects.write_links(vectors, members, clusters, 16).collect()
    assert links and all(r.paper_ids for r in links)


def test_map_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        projects.project_corpus(projects.MapStore(spark, str(tmp_path)), frame(spark, np.eye(3)).limit(0), spark.createDataFrame([], "id long, title string"), 3)


def test_encoder_is_pluggable(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "id long, text string")
    found = {r.id: r.v for r in encode.encode_documents(rows, "text").collect()}
    assert found[1] == found[3] and abs(np.linalg.norm(found[1]) - 1) < 1e-5 and not any(found[2])
    ones = encode.encode_documents(rows, "text", lambda: lambda texts: np.ones((len(texts), 4))).first().v
    assert ones == [0.5] * 4


def test_answers(spark):
    clusters = spark.createDataFrame([(0, "Protein folding", 9, ["a"] * 20), (1, "Deep protein folding", 12, ["b"])], "cluster long, label string, size long, terms array<string>")
    assert facade.match_region(clusters, "protein").first().cluster == 1
    assert facade.match_region(clusters, "the protein folding").first().cluster == 0
    assert facade.match_region(clusters, "absent").count() == 0
    assert [len(r.terms) for r in facade.list_regions(clusters).collect()] == [1, 8]
    papers = spark.createDataFrame([(1, "Known title", "A. Bee and C. Dee")], "id long, title string, authors string")
    links = spark.createDataFrame([(0, 1, 0.5, [2, 1])], "source_id long, target_id long, similarity double, paper_ids array<long>")
    row = facade.relationships(links, clusters, papers).first()
    assert (row.source_label, row.target_label, row.titles) == ("Protein folding", "Deep protein folding", ["", "Known title"])
    assert papers.select(facade.first_author(F.col("authors")).alias("a")).first().a == "A. Bee"
    with pytest.raises(ValueError, match="no such mode"):
        facade.search_library(papers, "other", "x")
    q = spark.createDataFrame([(1, "auto"), (2, "pending_review")], "id long, status string")
    v = spark.createDataFrame([(2, "confirmed")], "id long, verdict string")
    assert {r.id: r.status for r in facade.review_writes(q, v).collect()} == {1: "auto", 2: "confirmed"}
