"""What only shows on tables larger than the test tables, on small rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.plans.registry import ORACLES, QUERIES


def embeddings(spark, path, ids, labels, matrix):
    rows = [(int(i), int(c), [float(x) for x in v]) for i, c, v in zip(ids, labels, matrix, strict=True)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    return con


def test_long_arxiv_numbers_are_not_cut(spark):
    found = lambda t: spark.range(1).select(tx.find_arxiv(F.lit(t)).alias("x")).first()["x"]
    assert found("See arXiv: 2101.110007 and") == "2101.110007"
    assert found("arXiv:2101.00001v3.") == "2101.00001v3"


@pytest.mark.parametrize("name", ["s16_upsert_vectors", "s16_write_vectors"])
def test_second_times_do_not_fall_on_stored_ids(spark, tmp_path, name):
    ids = [0, 1, 2, 100000, 100001, 100002, 200001]
    con = embeddings(spark, str(tmp_path), ids, [0, 1, 1, 0, 1, 2, 3], np.random.default_rng(0).normal(size=(7, 64)))
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.version) for r in found) == sorted(con.sql(ORACLES[name]).fetchall())


def test_compared_rows_grow_with_the_vectors(spark):
    """Four times the vectors send four times the bytes to the tasks that compare, and give each query k candidates for each part of the vectors."""
    from lectern.operators import cells, neighbours, pairs
    from tests.test_vectors import _all_pairs, _rows

    def sent(n):
        rows = spark.range(n).select("id", F.array(*[F.rand(k) - 0.5 for k in range(8)]).alias("v"), (F.col("id") % 4).alias("part"))
        packed = pairs.packed(rows)
        return pairs.dealt(packed, packed.withColumn("part", F.col("part") % 2), 4, 2).agg(F.sum(F.length("matrix"))).first()[0], rows

    small, _ = sent(1000)
    large, rows = sent(4000)
    assert large == 4 * small == 4000 * 64 * (2 + 4)
    matrix = np.random.default_rng(2).normal(size=(1500, 8))
    matrix[700:] = matrix[:800]
    matrix[3] = 0
    u = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(matrix)], "id long, v array<double>")
    want = _all_pairs(u, 7)
    assert _rows(neighbours.top_k(v, v, 7)) == want
    index = cells.build(v, len(matrix), cells=20, block_rows=64)
    assert _rows(cells.top_k(index, index, 7)) == want
    assert neighbours.top_k(v, v.limit(0), 7).count() == 0 == neighbours.top_k(v.limit(0), v, 7).count()


@pytest.mark.parametrize("name", ["html", "chunks"])
def test_long_texts_reach_python_few_at_a_time(name):
    """Ten thousand of them in one Arrow batch took gigabytes."""
    from pyspark.util import PythonEvalType

    from lectern.operators import chunks
    from lectern.sources import html

    function = {"html": html.markdown_of, "chunks": chunks._pieces}[name]
    assert function.evalType == PythonEvalType.SQL_BATCHED_UDF


def test_words_of_texts_do_not_move(spark):
    """Texts are dealt by document before they are cut; no exchange carries a row for each word."""
    from lectern.operators import catalog, search

    docs = spark.createDataFrame([(1, "en", "there and then"), (2, "en", "these there")], "chunk_id long, section string, text string")
    for made in (search.search(search.postings(docs), "the* and"), catalog.topic_terms(docs, "chunk_id")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and not any("term" in line for line in moved)


def test_compared_vectors_are_dealt_once(spark):
    """No side is multiplied before it is moved, more vectors than one Arrow batch or part holds meet every query, and empty parts do no harm."""
    from lectern.operators import pairs

    rows = spark.range(300).select("id", F.array(*[F.rand(k) - 0.5 for k in range(4)]).alias("v"), F.pmod("id", F.lit(6)).alias("part")).repartition(5).cache()
    left, right = pairs.packed(rows.where("part <> 2")), pairs.packed(rows.withColumn("part", F.col("part") % 2))
    met = pairs.dealt(left, right, 6, 3)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and 0 < plan.index("Generate") < plan.index("CartesianProduct") < plan.index("Exchange")
    found = pairs.best(met, 300, None, True).select("i", "j")
    assert found.count() == found.distinct().count() == 250 * 299
    rows.unpersist()
