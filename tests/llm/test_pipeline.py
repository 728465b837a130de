"""The pipeline's stages against plain versions of what they decide."""

from __future__ import annotations

import hashlib
import importlib.util
import os

import pytest

from tests.llm.test_dedup import awkward, plain_near

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir("/root/testdata/sf0.001"), reason="no pipeline or tables")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from lectern.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == seen[name].columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    kept = {i for i, _ in rows(seen["exact_dedup"])}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.1 * len(bad)

    best = {}
    for i, t in rows(seen["exact_dedup"]):
        best[t or ""] = max(best.get(t or "", i), i)
    assert sorted(rows(seen["near_dedup"])) == sorted((i, t) for t, i in best.items())

    near = rows(seen["near_dedup"])
    groups = plain_near(near, 5)  # the stage's shingles have five words; op7's contract alone has four
    assert sorted(i for i, _ in rows(seen["mix"])) == sorted(i for i, n, c, _ in groups if n == 0 or i == c)

    mixed = rows(seen["bpe"])
    sources = dict(rows(seen["mix"]))
    assert all(sources[i] == t for i, t in mixed)
    assert max(sum(1 for j, _ in mixed if j == i) for i, _ in mixed) <= 3

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in mixed)
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in docs.collect()) == want


def test_run_takes_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "words without an id", "en", "s", 19), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "t", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, schema).selectExpr("*", "1 AS id", "'x' AS kept", "2 AS _key").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(3, 1, 0)] if own else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        found = pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(found) > 0) == bool(own)


def test_stages_on_odd_rows(spark, tmp_path):
    """What each stage does with null, empty and very long texts, ties, repeats and clashing columns, as its docstring says."""
    import corpus_pipeline as pipeline

    long = "some words of a very long text that goes on " * 120_000
    rows = [(1, None, "s"), (2, "", "s"), (None, "words without an id", "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (4, "a b c d e f", "t"), (None, "A b c d e F", None), (5, long, "t"), (6, long, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "'x' AS kept", "2 AS _key", "3 AS row", "4 AS digest")
    shown = lambda df: sorted((str(r.doc_id), (r.text or "")[:20]) for r in df.collect())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.keep_good(spark, docs, str(tmp_path)).count() == 0
    assert shown(pipeline.drop_copies(spark, docs, "")) == sorted([("2", ""), ("None", "words without an id"), ("4", "a b c d e f"), ("None", "A b c d e F"), ("6", long[:20])])
    assert shown(pipeline.drop_near_copies(spark, docs, "")) == sorted([("1", ""), ("2", ""), ("None", "words without an id"), ("3", "a b c d e f"), ("5", long[:20])])
    mixed = shown(pipeline.mix_sources(spark, docs, ""))
    assert set(mixed) <= set(shown(docs)) and ("5", long[:20]) in mixed and max(mixed.count(x) for x in mixed) <= 6
    tokens = {(str(r.doc_id), r.n_tokens) for r in pipeline.to_tokens(spark, docs, "").collect()}
    assert ("1", 0) in tokens and ("2", 0) in tokens and len(tokens) == 8
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        assert name == "bpe" or stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_near_copies_are_told_by_five_words(spark):
    """Two edits in eighty words leave 0.81 of the shingles of four words and 0.77 of those of five."""
    import corpus_pipeline as pipeline

    words = [f"w{k}" for k in range(80)]
    edit = lambda *places: " ".join("new" if k in places else w for k, w in enumerate(words))
    rows = [(1, edit()), (2, edit(20, 60)), (3, edit(40)), (4, "short text"), (5, "Short TEXT"), (6, None), *awkward()[60:90]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect())
    wide = sorted(i for i, n, c, _ in plain_near(rows) if n == 0 or i == c)
    want = sorted(i for i, n, c, _ in plain_near(rows, 5) if n == 0 or i == c)
    assert kept == want != wide


def test_stages_take_repeated_rows(spark):
    """Rows without words stay whatever else repeats; rows that differ in their source alone are mixed apart."""
    import corpus_pipeline as pipeline

    blank = [(1, "", "s"), (1, "", "s"), (2, None, "s"), (2, None, "t")]
    for worded, left in (([], 0), ([(3, "a b c d e f", "s")] * 2, 1)):
        docs = spark.createDataFrame(blank + worded, "doc_id long, text string, source string")
        found = [r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()]
        assert sorted(found) == [1, 1, 2, 2] + [3] * left

    rows = [(k, f"words of text {k} for both", c) for k in range(40) for c in ("s", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    apart = spark.createDataFrame([(2 * k + (c == "t"), t, c) for k, t, c in rows], docs.schema)
    count = lambda df: {r.source: r["count"] for r in pipeline.mix_sources(spark, df, "").groupBy("source").count().collect()}
    assert count(docs) == count(apart)
