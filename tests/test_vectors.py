"""Vectors with a planted structure: graphs, trails, bridges, layouts, clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import bridges, cells, clustering, maps, neighbours, reading, trails, umap


def frame(spark, matrix, **extra):
    columns = ["id", "v", *extra]
    rows = [(k, [float(x) for x in row], *[extra[c][k] for c in extra]) for k, row in enumerate(matrix)]
    return spark.createDataFrame(rows, columns)


def blobs(groups=3, each=20, dim=16, spread=0.5, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 6
    return np.concatenate([c + rng.normal(size=(each, dim)) * spread for c in centres]), np.repeat(np.arange(groups), each)


def test_top_k_equals_brute_force_in_any_blocks(spark):
    matrix = np.random.default_rng(1).normal(size=(90, 8))
    u = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(-s[i], kind="stable")[:4]}
    for rows in (7, 1024):
        v = frame(spark, matrix)
        assert {(r.i, r.j) for r in neighbours.top_k(v, v, 4, block_rows=rows).collect()} == want


def _all_pairs(u, k):
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return {(i, int(j)) for i in range(len(u)) for j in np.lexsort((np.arange(len(u)), -np.round(s[i], 12)))[:k]}


def _rows(df):
    return {(r.i, r.j) for r in df.collect()}


def test_cells_leave_out_what_cannot_be_near(spark, monkeypatch):
    """Clustered vectors, equal ones, and one of no length: the rows of all pairs, from a part of the blocks."""
    matrix, _ = blobs(groups=12, each=30, dim=16, spread=0.4, seed=4)
    matrix = np.concatenate([matrix, np.repeat(matrix[:1], 40, axis=0), np.zeros((1, 16))])
    u = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    v = frame(spark, matrix)
    index = cells.build(v, len(matrix), cells=12, block_rows=16)
    made = cells.plan(index, index, 5, None, True, None).collect()
    compared = sum(len(r.rows) // 4 for r in made)
    assert _rows(cells.top_k(index, index, 5)) == _all_pairs(u, 5)
    assert compared < 0.35 * len(matrix) * 12
    sizes = {(r.cell, r.block): r.n for r in index.rows.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes.values()) < 45
    monkeypatch.setattr(neighbours, "PAIRS", 4)
    assert _rows(neighbours.top_k(v, v, 5, block_rows=32)) == _all_pairs(u, 5)


def test_probes_find_nine_of_ten(spark):
    matrix, _ = blobs(groups=20, each=25, dim=24, spread=2.5, seed=8)
    u = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    index = cells.build(frame(spark, matrix), len(matrix))
    want = _all_pairs(u, 10)
    found = _rows(cells.top_k(index, index, 10, probes=6))
    assert len(found & want) >= 0.9 * len(want)
    made = cells.plan(index, index, 10, None, True, 6).collect()
    assert sum(len(r.rows) // 4 for r in made) == 6 * len(matrix)


def silhouette(points, labels):
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    out = []
    for i in range(len(points)):
        means = [d[i, (labels == g) & (np.arange(len(points)) != i)].mean() for g in np.unique(labels)]
        own = means.pop(int(labels[i]))
        out.append((min(means) - own) / max(own, min(means)))
    return float(np.mean(out))


def test_layout_keeps_planted_groups_apart(spark, monkeypatch):
    """Twelve groups in 32 dimensions on three axes: clearer than by PCA, in one block and in several, and the same when it is run again."""
    matrix, labels = blobs(groups=12, each=20, dim=32, spread=2.0, seed=6)
    v = frame(spark, matrix)
    as_matrix = lambda df: np.array([r.p for r in df.orderBy("id").collect()])
    found = as_matrix(umap.layout(v))
    mean, components = maps.fit_pca(v, 32)
    flat = np.array([[r.x, r.y, r.z] for r in maps.project(v, mean, components).orderBy("id").collect()])
    by_pca, by_umap = silhouette(flat, labels), silhouette(found, labels)
    print("silhouette", by_pca, by_umap)
    assert by_umap > by_pca + 0.1
    assert (as_matrix(umap.layout(v)) == found).all()
    new = frame(spark, matrix[::7] + 0.01)
    moved = as_matrix(umap.place(new, v, frame(spark, found).select("id", F.col("v").alias("p"))))
    monkeypatch.setattr(umap, "BLOCK_POINTS", 64)
    monkeypatch.setattr(umap, "POOL", 32)
    assert silhouette(as_matrix(umap.layout(v)), labels) > by_pca + 0.1
    assert moved.shape == (len(matrix[::7]), 3) and np.isfinite(moved).all()


def test_layout_of_few_vectors(spark):
    few = umap.layout(frame(spark, np.random.default_rng(0).normal(size=(9, 5))))
    assert few.count() == 9
    assert umap.layout(frame(spark, np.eye(3)).limit(0)).count() == 0
    a, b = umap.curve(0.05)
    assert 1.5 < a < 2.1 and 0.75 < b < 0.95


def test_nearest_of_no_length_is_empty(spark):
    v = frame(spark, np.eye(4))
    assert neighbours.nearest(v, [0.0] * 4, 3).count() == 0
    assert [r.id for r in neighbours.nearest(v, [1.0, 0.5, 0, 0], 2, [0]).collect()] == [1, 2]


def test_trails_complete_and_jump(spark):
    rng = np.random.default_rng(3)
    islands = np.concatenate([np.eye(8)[k] + rng.normal(size=(6, 8)) * 0.05 for k in range(2)])
    v = frame(spark, islands)
    edges = neighbours.routing_edges(v, 3)
    ends = spark.createDataFrame([(0, 0, 5), (1, 0, 11), (2, 4, 4)], "trail long, start long, goal long")
    found = {}
    for r in trails.find_paths(edges, v, ends).orderBy("trail", "place").collect():
        found.setdefault(r.trail, []).append(r)
    assert found[0][0].complete and (found[0][0].id, found[0][-1].id) == (0, 5)
    assert not found[1][0].complete and found[1][-1].id == 11
    assert [r.id for r in found[2]] == [4] and found[2][0].hops == 0
    relaxed = trails.relax_paths(edges, ends.where("trail = 0")).orderBy("place").collect()
    cost = {(r.a, r.b): r.distance for r in edges.collect()}
    total = lambda route: sum(cost[a, b] for a, b in zip(route, route[1:], strict=False))
    assert total([r.id for r in relaxed]) == pytest.approx(total([r.id for r in found[0]]))


def test_trails_by_joins_equal_those_by_heap(spark, monkeypatch):
    """A line of 16 hops, a branching graph with ties, and goals that lie on the other island."""
    rng = np.random.default_rng(4)
    turn = np.linspace(0, 3, 17)
    line = np.stack([np.cos(turn), np.sin(turn), 0 * turn, 0 * turn], axis=1)
    vectors = frame(spark, np.concatenate([line, rng.normal(size=(20, 4))])).coalesce(2).cache()
    links = {(k, k + 1): 0.1 for k in range(16)}
    links |= {(int(a), int(b)): round(float(w), 1) for a, b, w in zip(rng.integers(17, 37, 60), rng.integers(17, 37, 60), rng.uniform(0.1, 0.4, 60), strict=True) if a < b}
    edges = spark.createDataFrame([(*e, w) for (a, b), w in links.items() for e in ((a, b), (b, a))], "a long, b long, distance double").coalesce(2).cache()
    ends = spark.createDataFrame([(0, 0, 16), (1, 0, 20), (2, 26, 16), (3, 9, 9), (4, 17, 36), (5, 21, 31)], "trail long, start long, goal long").coalesce(1)
    rows = lambda: sorted((r.trail, r.place, r.id, r.complete, r.hops) for r in trails.find_paths(edges, vectors, ends).collect())
    want = rows()
    hops = {t: (n, done) for t, _, _, done, n in want}
    assert hops[0] == (16, True) and sum(r[0] == 0 for r in want) == 14
    assert not hops[1][1] and not hops[2][1] and max(hops[1][0], hops[2][0]) > 1
    monkeypatch.setattr(trails, "HEAP_EDGES", 0)
    assert rows() == want


def test_trails_by_joins_find_more_than_64_hops(spark, request):
    for name, value in (("spark.sql.shuffle.partitions", "1"), ("spark.sql.adaptive.enabled", "false")):  # many short rounds
        request.addfinalizer(lambda n=name, v=spark.conf.get(name): spark.conf.set(n, v))
        spark.conf.set(name, value)
    edges = spark.createDataFrame([(*e, 0.1) for k in range(66) for e in ((k, k + 1), (k + 1, k))], "a long, b long, distance double").coalesce(1)
    ends = spark.createDataFrame([(0, 0, 66)], "trail long, start long, goal long").coalesce(1)
    found = trails.relax_paths(edges, ends).orderBy("place").collect()
    assert [r.id for r in found] == trails.thin(list(range(67))) and found[0].complete and found[0].hops == 66


def test_thin_keeps_ends():
    assert trails.thin(list(range(40)))[0] == 0 and trails.thin(list(range(40)))[-1] == 39
    assert len(trails.thin(list(range(40)))) == 14
    assert trails.thin([1, 2]) == [1, 2]


def test_thin_is_alike_in_both_engines(spark):
    for n in (1, 2, 13, 14, 15, 27, 40, 41, 100):
        stops = list(range(100, 100 + n))
        for limit in (2, 5, 14):
            assert spark.createDataFrame([(stops,)], "s array<long>").select(trails.thinned(F.col("s"), limit)).first()[0] == trails.thin(stops, limit)


def test_density_clusters_are_alike_in_one_task_and_by_blocks(spark, monkeypatch):
    """Three sizes of spread, ties by copies, noise; blocks of a few points."""
    rng = np.random.default_rng(9)
    matrix = np.concatenate([blobs(3, 18, dim=12, spread=0.8, seed=2)[0], rng.normal(size=(14, 12)) * 6])
    matrix[5] = matrix[6] = matrix[7]
    v = frame(spark, matrix).coalesce(2).cache()
    rows = lambda: sorted((r.id, r.cluster, round(r.strength, 6)) for r in clustering.cluster_vectors(v).collect())
    want = rows()
    assert len({c for _, c, _ in want if c >= 0}) >= 3
    monkeypatch.setattr(clustering, "DENSITY_ROWS", 0)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 25)
    assert rows() == want
    few = frame(spark, matrix[:10])
    assert all(r.cluster == -1 for r in clustering.cluster_vectors(few).collect())


def test_bridges_need_a_paper_between(spark):
    rng = np.random.default_rng(5)
    shared = np.ones(16) * 0.6
    a = shared + np.eye(16)[0] + rng.normal(size=(12, 16)) * 0.15
    b = shared - np.eye(16)[0] + rng.normal(size=(12, 16)) * 0.15
    matrix, cluster = np.concatenate([a, b]), [0] * 12 + [1] * 12
    loose = frame(spark, matrix, cluster=cluster, strength=[0.5] * 24)
    firm = frame(spark, matrix, cluster=cluster, strength=[0.9] * 24)
    link = bridges.find_bridges(loose, dim=16).collect()
    assert len(link) == 1 and 0 < len(link[0].paper_ids) <= 6
    assert bridges.find_bridges(firm, dim=16).count() == 0


def test_procrustes_undoes_turn_mirror_scale_shift(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(30, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    moved = points @ turn * 2.5 + [4, -1, 3]
    make = lambda m: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(m)], "id long, x double, y double, z double")
    back = np.array([[r.x, r.y, r.z] for r in maps.align(make(moved), make(points).where("id < 12")).orderBy("id").collect()])
    assert np.allclose(back, points, atol=1e-8)
    same = maps.align(make(moved), make(points).where("id = 0")).orderBy("id").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in same], moved)


def test_drift_is_about_one_inside(spark):
    matrix, _ = blobs(2, 25)
    v = frame(spark, matrix)
    inside = neighbours.drift(v.where("id % 5 = 0"), v.where("id % 5 <> 0")).agg(F.avg("drift")).first()[0]
    assert 0.5 < inside < 2
    assert neighbours.drift(v, v.where("id < 10")).agg(F.max("drift")).first()[0] == 0.0


def test_hdbscan_finds_planted_blobs(spark):
    matrix, truth = blobs(3, 20)
    rows = clustering.cluster_vectors(frame(spark, matrix)).orderBy("id").collect()
    labels = np.array([r.cluster for r in rows])
    for g in range(3):
        own = labels[truth == g]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.9
    assert len(set(labels[labels >= 0])) == 3
    few = clustering.cluster_vectors(frame(spark, matrix[:10])).collect()
    assert all(r.cluster == -1 for r in few)


def test_scale_rules():
    assert [neighbours.neighbours_for(n) for n in (1, 2, 40, 64, 300, 5000)] == [5, 1, 5, 8, 17, 60]
    assert clustering.floor_candidates(9) == [3, 4, 5, 6]
    assert clustering.floor_candidates(400)[0] == 3 and clustering.floor_candidates(400)[-1] == 40
    assert [clustering.min_samples_for(n, 16) for n in (100, 400)] == [1, 4]


def test_reading_order_starts_at_the_entry_point(spark):
    matrix, truth = blobs(2, 8, dim=8)
    rows = frame(spark, matrix, cluster=[int(t) for t in truth], title=[f"Paper number {k}" if k != 3 else "A Survey of papers" for k in range(16)], abstract=["x"] * 16, year=[2000 + k for k in range(16)], pages=[20] * 16)
    scored = reading.rank_entry_points(rows, dim=8)
    best = {r.cluster: r.id for r in scored.where("place = 1").collect()}
    order = reading.reading_order(scored, limit=5).orderBy("cluster", "step").collect()
    assert all(r.id == best[r.cluster] for r in order if r.step == 0)
    assert len({(r.cluster, r.id) for r in order}) == 10
    assert best[0] == 3


def test_condensing_by_tables_equals_one_task(spark, monkeypatch):
    """Stretches of a few edges, several floors at once: the clusters, strengths and validities of clusters_of."""
    from lectern.operators import condensing

    monkeypatch.setattr(condensing, "CHUNK", 20)
    points, _ = blobs(groups=5, each=26, dim=4, spread=1.2, seed=11)
    points = np.concatenate([points, np.random.default_rng(1).normal(size=(30, 4)) * 5, points[:3]])
    n = len(points)
    tree = clustering.spanning_tree(points, 3)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in tree], "a long, b long, w double").repartition(3)
    nodes = condensing.merges(edges, n)
    sizes = {r.node: (r.left_size + r.right_size) for r in nodes.collect()}
    assert len(sizes) == n - 1 and sizes[2 * n - 2] == n
    for r in nodes.collect():
        assert sizes.get(r.left, 1) == r.left_size and sizes.get(r.right, 1) == r.right_size and r.node > max(r.left, r.right)
    floors = [3, 6, 12]
    keys = spark.createDataFrame([(f, 0, f, n) for f in floors], "key long, tree int, floor long, n long")
    clusters, out = condensing.condensed(nodes.withColumn("tree", F.lit(0)), keys)
    found = condensing.members(out, condensing.chosen(clusters, out)).cache()
    told = {r.key: r for r in condensing.validities(edges.withColumn("tree", F.lit(0)), keys, found).collect()}
    for floor in floors:
        labels, strength, validity = clustering.clusters_of(tree, n, floor)
        got = {r.point: (r.cluster, r.strength) for r in condensing.labelled(found.where(F.col("key") == floor)).collect()}
        assert [got.get(k, (-1, 0.0))[0] for k in range(n)] == labels.tolist() and labels.max() >= 1
        assert [got.get(k, (-1, 0.0))[1] for k in range(n)] == pytest.approx(strength.tolist())
        assert told[floor].validity == pytest.approx(validity) and told[floor].share == pytest.approx(clustering.dominant_share(labels))
    found.unpersist()


def test_trees_of_all_samples_equal_those_of_one_task(spark, monkeypatch):
    """Several numbers of samples in the same rounds; copies, more of them than samples, and ties on a grid of points."""
    rng = np.random.default_rng(4)
    lattice = np.stack(np.meshgrid(np.arange(5.0), np.arange(5.0), [0.0]), axis=-1).reshape(-1, 3)
    points = np.concatenate([blobs(3, 15, dim=3, spread=0.7, seed=3)[0], rng.normal(size=(10, 3)) * 4 + 20, lattice + 40, np.repeat([[7.0, 7, 7]], 9, axis=0)])
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 20)
    monkeypatch.setattr(clustering, "HIGH", 7)
    placed = spark.createDataFrame([(k, k, p.tolist()) for k, p in enumerate(points)], "place long, id long, p array<double>").repartition(3)
    found = {s: [] for s in (1, 3, 6)}
    for r in clustering._trees_by_blocks(placed, len(points), list(found), -(-len(points) // 20)).collect():
        found[r.tree].append((r.a, r.b, r.w))
    for s, got in found.items():
        want = clustering.spanning_tree(points, s)
        assert sorted(got) == sorted((int(a), int(b), w) for a, b, w in want)


def test_choice_of_clusters_in_a_chain_takes_few_rounds(spark, monkeypatch):
    """Clusters that lie one in another, seventy deep: tables are written for stretches, not for levels."""
    from lectern.operators import condensing

    deep, n = 70, 1000
    root = 2 * n - 2
    rows, at = [(0, root, None, 0.0, n)], root
    points = []
    for k in range(deep):  # each one splits into one that goes on and one of four points
        on, off = at - 2, at - 3
        rows += [(0, on, at, k + 1.0, n - 4 * (k + 1)), (0, off, at, k + 1.0, 4)]
        points += [(0, 4 * k + i, off, k + 1.5 + 2 * (k % 7 == 3)) for i in range(4)]
        at = on
    points += [(0, 4 * deep + i, at, deep + 1.25) for i in range(n - 4 * deep)]
    clusters = spark.createDataFrame(rows, "key long, cluster long, parent long, born double, size long").coalesce(1)
    out = spark.createDataFrame(points, "key long, point long, cluster long, density double").coalesce(1)
    written, write = [], condensing.materialize
    monkeypatch.setattr(condensing, "materialize", lambda df, name, **o: written.append(name) or write(df, name, **o))
    got = {}
    for chunk in (100_000, 40):
        written.clear()
        monkeypatch.setattr(condensing, "CHUNK", chunk)
        got[chunk] = {r.cluster: r.top for r in condensing.chosen(clusters, out).collect()}
        assert len(written) <= 16
    # By hand: excess of mass from the innermost out.
    own = {c: 0.0 for _, c, *_ in rows}
    born, parent = {c: b for _, c, _, b, _ in rows}, {c: p for _, c, p, *_ in rows}
    for _, c, p, b, size in rows[1:]:
        own[p] += (b - born[p]) * size
    for _, _, c, density in points:
        own[c] += density - born[c]
    inner, picked = dict.fromkeys(own, 0.0), {}
    kids = {p for p in parent.values() if p is not None}
    for c in sorted(own):
        picked[c] = c != root and (c not in kids or own[c] >= inner[c])
        if parent[c] is not None:
            inner[parent[c]] += own[c] if picked[c] else inner[c]
    want = {}
    for c in sorted(own, reverse=True):
        top = want.get(parent[c]) or (c if picked[c] else None)
        if top is not None:
            want[c] = top
    assert got[100_000] == got[40] == want


def test_layout_sends_a_place_once_to_a_block(spark, monkeypatch):
    """Edges are packed once for all rounds; a round sends a point to each block that has edges to it, not along each edge."""
    tables, write = {}, umap.materialize
    monkeypatch.setattr(umap, "materialize", lambda df, name, **o: tables.setdefault(name, []).append(df) or write(df, name, **o))
    monkeypatch.setattr(umap, "BLOCK_POINTS", 64)
    rows = spark.range(200).select("id", F.array(*[F.rand(k) for k in range(3)]).alias("p")).coalesce(1).cache()
    edges = rows.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("s")).select("a", ((F.col("a") + F.col("s")) % 200).alias("b"), F.lit(0.5).alias("w"))
    assert umap._optimised(edges, rows, 200, 3, 0.1, 1, 2, 1).count() == 200
    assert len(tables["umap-packed"]) == 1 and len(tables["umap-places"]) == 2
    sent = tables["umap-asked"][0].select(F.explode("to")).count()
    assert 0 < sent <= 200 * 3 < edges.count()
    rows.unpersist()


def test_floors_of_bounded_trees_are_tried_in_a_task_each(spark, monkeypatch):
    """No table of merges is written for trees of at most CHUNK edges; the rows are those of the tables."""
    from lectern.operators import condensing

    rng = np.random.default_rng(4)
    matrix = np.concatenate([blobs(4, 16, dim=8, spread=0.7, seed=3)[0], rng.normal(size=(12, 8)) * 6])
    v = frame(spark, matrix).coalesce(2).cache()
    written, write = [], condensing.materialize
    monkeypatch.setattr(condensing, "materialize", lambda df, name, **o: written.append(name) or write(df, name, **o))
    monkeypatch.setattr(clustering, "DENSITY_ROWS", 0)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 25)
    got = {}
    for chunk in (condensing.CHUNK, 20):
        monkeypatch.setattr(condensing, "CHUNK", chunk)
        got[chunk] = sorted((r.id, r.cluster, round(r.strength, 9)) for floor in (None, 5) for r in clustering.cluster_vectors(v, floor).collect())
        assert bool(written) == (chunk == 20)
    first, second = got.values()
    assert first == second and len({c for _, c, _ in first}) >= 4


def test_layout_weighs_neighbours_once(spark, monkeypatch):
    """The weights are written before they are read for both directions, so neighbours are compared once."""
    tables, write = [], umap.materialize
    monkeypatch.setattr(umap, "materialize", lambda df, name, **o: tables.append(name) or write(df, name, **o))
    rows = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.9), (1, 2, 0.5), (2, 1, 0.5)], "i long, j long, similarity double")
    found = {(r.a, r.b): r.w for r in umap.fuzzy_edges(rows).collect()}
    assert tables == ["umap-weights"] and len(found) == 4 and found[0, 1] == found[1, 0]


def test_blocks_out_of_reach_are_not_compared(spark, monkeypatch):
    """Vectors lie in blocks with their neighbours, copies included; a leaf that no point's bound reaches is passed by, and distances and edges are exact."""
    rng = np.random.default_rng(6)
    points = np.concatenate([blobs(8, 60, dim=4, spread=0.3, seed=5)[0], np.repeat([[50.0, 0, 0, 0]], 100, axis=0)])
    points = points[rng.permutation(len(points))]
    n = len(points)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 40)
    monkeypatch.setattr(clustering, "LEAF_ROWS", 10)
    monkeypatch.setattr(clustering, "ASKING_ROWS", 80)
    placed = spark.createDataFrame([(k, k, p.tolist()) for k, p in enumerate(points)], "place long, id long, p array<double>").repartition(3)
    table, count = clustering._in_blocks(placed, n, -(-n // 40))
    rows = table.collect()
    assert sorted(r.place for r in rows) == list(range(n)) and {r.block for r in rows} == set(range(count))
    blocks = [sorted((r.slot, r.place) for r in rows if r.block == b) for b in range(count)]
    assert all([s for s, _ in b] == list(range(len(b))) and len(b) <= 40 for b in blocks)
    places = [np.array([p for _, p in b]) for b in blocks]

    seen, within = [], clustering._within
    monkeypatch.setattr(clustering, "_within", lambda m, limit, o: seen.append(len(m) * len(o)) or within(m, limit, o))
    near = clustering._Near(4)
    for p in places:
        near.ask(p, points[p])
    for p in places:
        near.meet(p, points[p])
    want = np.sort(clustering.distances(points, points), axis=1)[:, :4]
    assert (np.sort(near.best, axis=1) == want[near.places]).all()
    assert sum(seen) < n * n / 3

    seen.clear()
    keys, cores = np.arange(n)[None], want[:, 3][None]
    out = clustering._Out({0: 0})
    for p in places:
        out.ask(p, points[p], cores[:, p], keys[:, p])
    for p in places:
        out.meet(p, points[p], cores[:, p], keys[:, p])
    assert sum(seen) < n * n / 3
    reach = np.maximum(np.maximum(clustering.distances(points, points), cores[0][:, None]), cores[0])
    np.fill_diagonal(reach, np.inf)
    got = {r["key"]: (r["w"], r["a"], r["b"]) for batch in out.found() for r in batch.to_pylist()}
    for x in range(1, n):
        w = reach[x].min()
        assert got[x] == min((w, min(x, y), max(x, y)) for y in np.flatnonzero(reach[x] == w).tolist())


def test_bounded_graphs_apart_are_joined_in_a_task_each(spark, monkeypatch):
    from lectern.functions import graphs

    written, write = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, name, **o: written.append(name) or write(df, name, **o))
    edges = spark.createDataFrame([(g * 100 + k, g * 100 + k + 1) for g in range(3) for k in range(20)], "a long, b long")
    found = graphs.connected_components(edges, small=20, apart=F.floor(F.col("a") / 100))
    assert written == ["cc-components"]
    assert sorted(map(tuple, found.collect())) == [(g * 100 + k, g * 100) for g in range(3) for k in range(21)]
