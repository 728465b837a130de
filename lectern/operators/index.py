"""A search index as written tables: postings in the order of terms, with the best that each block of chunks can score.

``postings`` (term, block, chunk_id, tf, size) are dealt out by ranges of (term, block) and sorted, so a term or a prefix is an
unbroken stretch that Parquet's statistics find, and a frequent term spans many files.  ``blocks`` (term, block, n, best) hold, for each term
in a block of chunks, how many chunks have it and the greatest weight that one of them gives it; ``corpus`` is one row.  A search reads
the stretches of its terms: first of ``blocks``, then of ``postings`` for the blocks that may hold one of the k best.

Every build writes a folder of its own and names it in ``versions`` last: a build that broke off is never seen, readers of
an older one aren't disturbed.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import delete
from .search import B, K1, _bm25, _terms, tokens

#: Chunks of a block, and postings of a file, about.
BLOCK_CHUNKS, FILE_ROWS = 1024, 500_000
#: Best blocks of a search that are scored first, to see what the others have to beat.
FIRST_BLOCKS = 16


class Index(NamedTuple):
    postings: DataFrame
    blocks: DataFrame
    corpus: DataFrame
    stemmed: bool


def _weight(tf: Column, size: Column, mean: Column) -> Column:
    """bm25 without the idf: it rises with tf, ever less, and never reaches K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def build(chunks: DataFrame, path: str, stemmed: bool = False) -> Index:
    """Writes the index of ``chunks`` (chunk_id, section, text) below ``path``; chunks without words aren't in it."""
    spark = chunks.sparkSession
    words = F.concat(tokens(F.coalesce("text", F.lit(""))), tokens(F.coalesce("section", F.lit(""))))
    if stemmed:
        from ..functions.stem import stems

        words = stems(words)
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    cut = chunks.select("chunk_id", words.alias("words")).select("chunk_id", "words", F.size("words").alias("size")).where("size > 0")
    # Cut once: the counts below read the sizes alone.
    cut.write.parquet(f"{folder}/words")
    cut = spark.read.parquet(f"{folder}/words")
    cut.select("chunk_id", "size", F.lit(stemmed).alias("stemmed")).groupBy("stemmed").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("size").alias("mean_size")).coalesce(1).write.parquet(f"{folder}/corpus")
    corpus = spark.read.parquet(f"{folder}/corpus")
    known = corpus.first()
    n = known["n_chunks"] if known else 0
    held = cut.select("chunk_id", "size", F.explode("words").alias("term")).groupBy("chunk_id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = held.select("term", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // BLOCK_CHUNKS)))).alias("block"), "chunk_id", "tf", "size")
    total = round(n * known["mean_size"]) if known else 0
    files = max(1, -(-total // FILE_ROWS))
    # Salted by chunk, so that one term's stretch is as many files as it needs.
    rows.repartitionByRange(files, "term", "block", "chunk_id").sortWithinPartitions("term", "block", "chunk_id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    weight = _weight(F.col("tf"), F.col("size"), F.lit(float(known["mean_size"]) if known else 1.0))
    best = postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("best"))
    best.repartitionByRange(max(1, files // 8), "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{folder}/blocks")
    delete(spark, f"{folder}/words")
    spark.createDataFrame([(time.time_ns(), folder)], "at long, folder string").coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/versions")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was finished last."""
    folder = spark.read.parquet(f"{path.rstrip('/')}/versions").orderBy(F.desc("at")).first()["folder"]
    postings, blocks, corpus = (spark.read.parquet(f"{folder}/{name}") for name in ("postings", "blocks", "corpus"))
    known = corpus.first()
    return Index(postings, blocks, corpus, bool(known and known["stemmed"]))


def stretch(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of the words that begin with one of the terms, each once a term that it begins with (``q``); both bounds of each stretch are pushed down."""
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | F.col("term").startswith(t)
    return rows.where(wanted).withColumn("q", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.col("term"), t))))


def bounds(index: Index, terms: list[str], found: DataFrame) -> DataFrame:
    """(block, bound): the greatest score that a chunk of a block can have, of blocks that hold every term."""
    corpus = F.broadcast(index.corpus.select("n_chunks"))  # one row
    each = stretch(index.blocks, terms).groupBy("q", "block").agg(F.least(F.sum("best"), F.lit(K1 + 1)).alias("best")).join(F.broadcast(found), "q").crossJoin(corpus)
    # A size at the mean and so large a tf that the weight is what stands in "best": the idf alone is left.
    idf = _bm25(F.lit(1.0), F.col("df"), F.lit(1.0), F.col("n_chunks"), F.lit(1.0))
    return each.groupBy("block").agg(F.sum(idf * F.col("best")).alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("block", "bound")


def frequencies(index: Index, terms: list[str]) -> DataFrame:
    """(q, df): chunks that hold a word which begins with the term."""
    return stretch(index.postings, terms).select("q", "chunk_id").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("df"))


def _scored(index: Index, terms: list[str], found: DataFrame, blocks: DataFrame) -> DataFrame:
    rows = stretch(index.postings, terms).join(blocks.select("block"), "block", "left_semi")
    hits = rows.groupBy("chunk_id", "size", "q").agg(F.sum("tf").alias("tf")).join(F.broadcast(found), "q").crossJoin(F.broadcast(index.corpus))
    part = _bm25(F.col("tf"), F.col("df"), F.col("size"), F.col("n_chunks"), F.col("mean_size"))
    return hits.groupBy("chunk_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("chunk_id", "score")


def top(index: Index, query: str, k: int) -> DataFrame:
    """(chunk_id, score) of the k best chunks that hold every term of the query as the beginning of a word; ties fall by chunk.

    The rows are those of ``search`` in that order, scores rounded to 4 digits as they are shown.  Two small results reach the driver: the frequency
    of each term and the k-th score of the first blocks.
    """
    terms = _terms(query, index.stemmed)
    spark = index.postings.sparkSession
    none = spark.createDataFrame([], "chunk_id long, score double")
    if not terms:
        return none
    counted = frequencies(index, terms).collect()  # one row a term of the query
    if len(counted) < len(terms):
        return none
    found = spark.createDataFrame(counted, "q string, df long")
    bound = bounds(index, terms, found)
    shown = F.round("score", 4)
    first = bound.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)
    best = _scored(index, terms, found, first).select(shown.alias("score")).orderBy(F.desc("score")).limit(k).collect()  # k numbers
    least = best[-1]["score"] if len(best) == k else 0.0
    # Rounding may lift a score by half of the last digit.
    may = bound.where(F.col("bound") >= least - 1e-4)
    return _scored(index, terms, found, may).select("chunk_id", shown.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
