"""Tables written by key, the neighbour table that follows its vectors, the written search index, the map's payload."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.keyed import KeyedTable
from lectern.functions.partitions import indexed
from lectern.operators import catalog, edges, index, neighbours, projects, search
from tests.test_vectors import blobs, frame


def _files(table):
    """Data files of the current version, by bucket."""
    return {b: sorted(p.name for p in Path(folder.removeprefix("file:"), f"bucket={b}").glob("*.parquet")) for b, folder in table.current()[1].items()}


def test_a_write_touches_its_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=8)
    assert table.read() is None and table.vacuum() == 0
    rows = spark.range(200).select("id", F.lit("old").alias("v"))
    assert table.upsert(rows) == list(range(8))
    before, where = _files(table), table.current()[1]
    touched = table.upsert(spark.createDataFrame([(3, "new"), (500, "new")], "id long, v string"))
    after = table.current()[1]
    assert 0 < len(touched) <= 2 and table.current()[0] == 1
    assert all(after[b] == where[b] for b in range(8) if b not in touched) and all(after[b] != where[b] for b in touched)
    assert {b: f for b, f in _files(table).items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    found = {r.id: r.v for r in table.read().collect()}
    assert len(found) == 201 and found[3] == found[500] == "new" and found[4] == "old"
    table.replace(spark.range(5))
    assert table.read().count() == 196
    kept = {Path(f.removeprefix("file:")) for f in table.current()[1].values()}
    gone = set((tmp_path / "t/data").iterdir()) - kept
    assert table.vacuum() == len(gone) and set((tmp_path / "t/data").iterdir()) == kept
    assert table.read().count() == 196 and table.current()[0] == 2
    table.replace(spark.range(600))
    assert table.read() is None and table.upsert(rows.limit(0)) == []
    table.upsert(rows)
    assert table.read().count() == 200


def test_a_write_that_breaks_off_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    catalog.write_vectors(table, spark.createDataFrame([(1, "m", [1.0, 2.0])], "id long, model_id string, v array<double>"), "m", 2)
    with pytest.raises(Exception, match="another model or length"):
        catalog.write_vectors(table, spark.createDataFrame([(1, "m", [3.0, 4.0]), (2, "other", [1.0, 2.0])], "id long, model_id string, v array<double>"), "m", 2)
    assert [r.v for r in table.read().collect()] == [[1.0, 2.0]]
    # The data of a version without the version itself.
    spark.range(9).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/broken"))
    assert table.read().count() == 1 and table.current()[0] == 0
    spark.createDataFrame([(0, "x")], "bucket int, folder string").write.parquet(str(tmp_path / "t/versions/version=1"))
    other = KeyedTable(spark, str(tmp_path / "t"), "id")
    other.current = lambda: (0, table.current()[1] and {})
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):  # somebody else finished that version
        other.upsert(spark.createDataFrame([(5, "m", [1.0, 2.0])], "id long, model_id string, v array<double>"))


def _near(rows):
    return {r.id: [(x.j, round(x.similarity, 10)) for x in r.near] for r in rows.collect()}


def test_edges_follow_the_vectors(spark, tmp_path, monkeypatch):
    """Added, changed and removed vectors: the lists of a rebuild, with few vectors compared with all."""
    monkeypatch.setattr(edges, "LISTED", 5)
    matrix, _ = blobs(groups=6, each=15, dim=8, spread=0.6, seed=3)
    matrix = np.concatenate([matrix, matrix[:4]])  # ties
    table = KeyedTable(spark, str(tmp_path / "edges"), "id", buckets=8)
    one = frame(spark, matrix)
    assert edges.update(table, one.where("id < 80")).whole == 80
    assert edges.update(table, one.where("id < 80")) == (0, 0, 0, 0)
    key = edges.content_key(table, "m")
    assert key == edges.content_key(table, "m") and key[:2] == ("m", 80)
    again = one.where("id <> 7").withColumn("v", F.when(F.col("id") == 20, F.reverse("v")).otherwise(F.col("v")))
    done = edges.update(table, again)
    assert done.removed == 1 and done.whole < 60 and done.written <= done.whole + done.partial
    rebuilt = KeyedTable(spark, str(tmp_path / "fresh"), "id", buckets=8)
    edges.update(rebuilt, again)
    assert _near(table.read()) == _near(rebuilt.read())
    assert edges.content_key(table, "m") == edges.content_key(rebuilt, "m") != key
    # One vector turned: the count is the same, the key isn't.
    turned = again.withColumn("v", F.when(F.col("id") == 3, F.reverse("v")).otherwise(F.col("v")))
    before = edges.content_key(table, "m")
    edges.update(table, turned)
    assert edges.content_key(table, "m")[:2] == before[:2] and edges.content_key(table, "m") != before
    want = {(r.a, r.b): round(r.distance, 9) for r in neighbours.routing_edges(turned, 4).collect()}
    assert {(r.a, r.b): round(r.distance, 9) for r in edges.routing_edges(table, 4).collect()} == want


def test_an_update_compares_once(spark, tmp_path, monkeypatch):
    """What was compared is written before it is read twice, so that it isn't compared again and its shuffle files go."""
    met = spark.sparkContext.accumulator(0)
    best = edges.neighbours.pairs.best

    def counted(rows, *args):
        def run(batches):
            for batch in batches:
                met.add(sum(1 for side in batch["side"] if side.as_py() == 0))
                yield batch

        return best(rows.mapInArrow(run, rows.schema), *args)

    monkeypatch.setattr(edges.neighbours.pairs, "best", counted)
    table = KeyedTable(spark, str(tmp_path / "edges"), "id", buckets=4)
    assert edges.update(table, frame(spark, blobs(groups=2, each=15, dim=8, spread=0.6, seed=3)[0]).coalesce(1)).written == 30
    assert met.value == 1


def test_edges_of_one_vector_and_of_none(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "edges"), "id")
    edges.update(table, frame(spark, np.eye(3)).limit(1))
    assert _near(table.read()) == {0: []}
    edges.update(table, frame(spark, np.eye(3)).limit(0))
    assert table.read() is None


def _chunks(spark, n=300):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["common", "commonly", "rare"]
    share = np.r_[np.full(40, 1.0), 25, 10, 0.02]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum())) for _ in range(n)]
    return spark.createDataFrame([(k, "sec", t) for k, t in enumerate(texts)], "chunk_id long, section string, text string")


def test_index_gives_the_rows_of_a_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(index, "FILE_ROWS", 800)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 3)
    chunks = _chunks(spark)
    made = index.build(chunks, str(tmp_path / "index"))
    plain = search.postings(chunks).cache()
    for query, k in (("common", 7), ("com w1", 10), ("rare", 5), ("w1* w2 common", 500), ("absent", 3), ("sec w3", 1), ("***", 4)):
        scored = search.search(plain, query).select("chunk_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
        want = [tuple(r) for r in scored.collect()] if query != "***" else []
        assert [tuple(r) for r in index.top(made, query, k).collect()] == want, query
    plain.unpersist()
    # A prefix is a stretch: its bounds reach the scan, and its postings stand in few of the files.
    plan = index.stretch(made.postings, ["rare"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,rare)" in plan
    names = lambda rows: rows.select(F.input_file_name().alias("f")).distinct().count()
    assert names(made.postings) > 5 and names(index.stretch(made.postings, ["rare"])) == 1
    assert names(index.stretch(made.postings, ["common"])) > 1
    # Blocks that can't reach the k-th score aren't scored.
    found = index.frequencies(made, ["rare"])
    bound = index.bounds(made, ["rare"], found)
    assert bound.count() < made.blocks.select("block").distinct().count()


def test_a_broken_build_is_not_seen(spark, tmp_path):
    chunks = _chunks(spark, 20)
    index.build(chunks, str(tmp_path / "index"))
    (tmp_path / "index" / "half").mkdir()
    made = index.build(chunks.where("chunk_id < 10"), str(tmp_path / "index"), stemmed=True)
    assert made.stemmed and index.opened(spark, str(tmp_path / "index")).corpus.first()["n_chunks"] <= 10


def test_places_without_a_window(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"))
    found = indexed(rows, "x", range_rows=90)
    assert found.where("x <> place").count() == 0 and found.select("range").distinct().count() > 5
    assert indexed(rows.limit(0), "x").count() == 0
    assert "Window" not in found._jdf.queryExecution().toString()


def test_payload_blocks_are_the_arrays(spark):
    nodes = spark.range(250).select(F.floor(F.col("id") / 100).cast("int").alias("range"), F.col("id").alias("node_index"), F.array(*[(F.col("id") * k).cast("float") for k in (1, 2, 3)]).alias("position"), F.when(F.col("id") > 5, F.col("id") % 4).alias("cluster"), (F.col("id") % 2 == 0).alias("provisional"))
    blocks = projects.payload_blocks(nodes).orderBy("first").collect()
    assert [(r.first, r.n) for r in blocks] == [(0, 100), (100, 100), (200, 50)]
    flat = b"".join(r.positions for r in blocks)
    assert struct.unpack("<3f", flat[12 * 7 : 12 * 8]) == (7.0, 14.0, 21.0) and len(flat) == 250 * 12
    assert struct.unpack("<i", b"".join(r.clusters for r in blocks)[4 * 3 : 4 * 4]) == (-1,)
    assert b"".join(r.flags for r in blocks)[:4] == b"\x01\x00\x01\x00"


def test_payloads_are_equal_by_content(spark):
    rows = [('{"a": 1, "b": {"c": [1, 2], "d": null}}', '{"b":{"d":null,"c":[1,2]},"a":1}', True), ('{"a": [1, 2]}', '{"a": [2, 1]}', False), ('{"a": 1}', '{"a": "1"}', False), ("[]", "{}", False), ('{"é": "\\u00e9"}', '{"\\u00e9":"é"}', True)]
    found = spark.createDataFrame(rows, "a string, b string, same boolean").select("same", (tx.canonical_json(F.col("a")) == tx.canonical_json(F.col("b"))).alias("found"))
    assert all(r.same == r.found for r in found.collect())
    assert spark.range(1).select(tx.canonical_json(F.lit('{"a": ')).alias("x")).first().x is None
