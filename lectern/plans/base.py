"""Registration of queries and their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that checks it."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of a document library as expressions over the given ones; the expressions mean the same in
#: Spark and in the SQL that checks the queries, so both sides start from equal rows.
LIBRARY = {
    "papers": (
        "documents",
        {
            "id": "doc_id",
            "title": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE trim(substr(replace(text, chr(10), ' '), 1, 40)) END",
            "abstract": "substr(replace(text, chr(10), ' '), 41, 400)",
            "lang": "lang",
            "source": "source",
            "n_chars": "n_chars",
            "year": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1990 + doc_id % 35 END",
            "pages": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(floor(CAST(n_chars AS DOUBLE) / 60) AS BIGINT) END",
            "doi": "CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1234/ABC.', CAST(doc_id % 300 AS VARCHAR(20)), '.') END",
            "arxiv_id": "CASE WHEN doc_id % 4 = 0 THEN concat('arXiv:2101.', CAST(10000 + doc_id % 500 AS VARCHAR(20)), 'v', CAST(1 + doc_id % 3 AS VARCHAR(20))) END",
            "authors": "concat('Ada L', CAST(doc_id % 9 AS VARCHAR(20)), 'velace2,3, B. Turing* and Name')",
            "status": "CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'quarantined' ELSE 'ready' END",
            "confidence": "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(doc_id % 97 AS DOUBLE) / 97 END",
            "path": "concat('lib/', lang, '/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt')",
        },
    ),
    "vectors": ("embeddings", {"id": "vec_id", "v": "embedding", "cluster": "label", "strength": "CAST(vec_id % 100 AS DOUBLE) / 100"}),
    "quantities": (
        "lineitem",
        {
            "id": "l_orderkey * 10 + l_linenumber",
            "paper_id": "l_orderkey % 1000",
            "chunk_ord": "l_linenumber",
            "quantity_kind": "CASE l_linenumber % 4 WHEN 0 THEN 'length' WHEN 1 THEN 'mass' WHEN 2 THEN 'time' ELSE 'frequency' END",
            "value_si": "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity * 1000 END",
            "unit_si": "CASE l_linenumber % 4 WHEN 0 THEN 'meter' WHEN 1 THEN 'kilogram' WHEN 2 THEN 'second' ELSE 'hertz' END",
            "unit_original": "CASE l_linenumber % 4 WHEN 0 THEN 'km' WHEN 1 THEN 't' WHEN 2 THEN 'ks' ELSE 'kHz' END",
            "context": "concat('Batch ', l_returnflag, ' 100% of ', l_linestatus)",
            "status": "CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'auto' ELSE 'confirmed' END",
        },
    ),
    "jobs": (
        "events",
        {
            "id": "event_id",
            "kind": "CASE event_id % 10 WHEN 0 THEN 'parse' WHEN 1 THEN 'metadata' WHEN 2 THEN 'embed' WHEN 3 THEN 'extract' WHEN 4 THEN 'project' WHEN 5 THEN 'enrich' WHEN 6 THEN 'measure' WHEN 7 THEN 'adjudicate' WHEN 8 THEN 'tag' ELSE 'insight' END",
            "paper_id": "CASE WHEN event_id % 10 = 4 THEN NULL ELSE user_id END",
            "state": "CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'dead' WHEN 4 THEN 'queued' ELSE 'done' END",
            "attempts": "event_id % 4",
            "max_attempts": "3",
            "ts": "ts",
            "value": "value",
        },
    ),
    "paper_tags": ("orders", {"paper_id": "o_orderkey % 1000", "slug": "o_orderpriority", "confidence": "o_totalprice / 1000000"}),
}


def library(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = LIBRARY[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{expression} AS {column}" for column, expression in columns.items()])


def cte(*names: str) -> str:
    """WITH clauses of library tables for the checking SQL."""
    parts = []
    for name in names:
        base, columns = LIBRARY[name]
        listed = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
        parts.append(f"{name} AS (SELECT {listed} FROM {base})")
    return "WITH " + ", ".join(parts) + " "
