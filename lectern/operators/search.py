"""Full-text search: an inverted index as a table, bm25 over prefix terms, snippets; title search; reading windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import best_per_paper

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS, SNIPPET_CHARS = 24, 240


def query_terms(query: str) -> list[str]:
    """Words of a query, with the characters that search engines read as operators taken out."""
    return re.sub(r'["^*():]', " ", query).split()


def match_expression(query: str) -> str:
    """Each word as a quoted prefix."""
    return " ".join(f'"{t}"*' for t in query_terms(query))


def match_expressions(queries: Column) -> Column:
    """As match_expression, of a column of queries."""
    words = F.filter(F.split(F.regexp_replace(queries, r'["^*():]', " "), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """(chunk_id, term, tf): the inverted index of text and section; ``chunks`` has chunk_id, section and text.

    Chunks are dealt by id before they are cut, so a text moves once and its words don't.
    """
    words = F.concat(tokens(F.coalesce("text", F.lit(""))), tokens(F.coalesce("section", F.lit(""))))
    if stemmed:
        from ..functions.stem import stems

        words = stems(words)
    return chunks.select("chunk_id", "section", "text").repartition("chunk_id").select("chunk_id", F.explode(words).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _terms(query: str, stemmed: bool) -> list[str]:
    terms = list(dict.fromkeys(t for q in query_terms(query.lower()) for t in re.findall(r"\w+", q)))
    if stemmed:
        from ..functions.stem import stem

        terms = [stem(t) for t in terms]
    return terms


def _bm25(tf: Column, df: Column, size: Column, chunks: Column, mean: Column) -> Column:
    """k1 1.2, b 0.75; the idf is at least 1e-6."""
    idf = F.greatest(F.ln((chunks - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def search(index: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """(chunk_id, score) of indexed chunks that hold every term as the beginning of a word; bm25, a term counting all words it begins."""
    terms = _terms(query, stemmed)
    if not terms:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    # A chunk's size and what it holds of every term, in one pass.
    held = [F.sum(F.when(F.startswith(F.col("term"), F.lit(t)), F.col("tf")).otherwise(0)).alias(f"tf{k}") for k, t in enumerate(terms)]
    counts = index.groupBy("chunk_id").agg(F.sum("tf").alias("size"), *held)
    return _score_counts(counts, len(terms))


def scan(chunks: DataFrame, query: str) -> DataFrame:
    """As ``search``, without an index: one pass counts, one scores; only one row of counts is shuffled."""
    terms = _terms(query, False)
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    words = F.concat(tokens(F.coalesce("text", F.lit(""))), tokens(F.coalesce("section", F.lit(""))))
    cut = chunks.select("chunk_id", words.alias("words"))
    counts = cut.select("chunk_id", F.size("words").alias("size"), *[F.size(F.filter("words", _begins(t))).alias(f"tf{k}") for k, t in enumerate(terms)]).where("size > 0")
    return _score_counts(counts, len(terms))


def _score_counts(counts: DataFrame, terms: int) -> DataFrame:
    """(chunk_id, score) of the chunks that hold every term, from (chunk_id, size, tf0, tf1, ...)."""
    corpus = counts.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("size").alias("mean_size"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(terms)])
    held = counts
    for k in range(terms):
        held = held.where(F.col(f"tf{k}") > 0)
    score = sum((_bm25(F.col(f"tf{k}"), F.col(f"df{k}"), F.col("size"), F.col("n_chunks"), F.col("mean_size")) for k in range(terms)), F.lit(0.0))
    return held.crossJoin(F.broadcast(corpus)).select("chunk_id", score.alias("score"))


def _begins(term: str):
    return lambda w: F.startswith(w, F.lit(term))


def snippet(text: Column, terms: list[str]) -> Column:
    """About 24 words around the first match, at most 240 characters; "…" where the text goes on."""
    words = F.split(tx.squeeze(text), " ")
    found = F.transform(words, lambda w: F.lit(False) if not terms else _any_prefix(F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+", ""), terms))
    at = F.greatest(F.coalesce(F.array_position(found, True), F.lit(1)) - 5, F.lit(1)).cast("int")
    cut = F.array_join(F.slice(words, at, SNIPPET_TOKENS), " ")
    whole = F.concat(F.when(at > 1, "…").otherwise(""), cut, F.when(F.size(words) >= at + SNIPPET_TOKENS, "…").otherwise(""))
    return F.substring(whole, 1, SNIPPET_CHARS)


def _any_prefix(word: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.startswith(word, F.lit(t))
    return out


def search_fulltext(chunks: DataFrame, index: DataFrame | None, papers: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The best chunk of each paper among the first three times ``limit`` hits, with title and snippet; without an index the chunks are scanned."""
    found = scan(chunks, query) if index is None else search(index, query)
    hits = found.join(chunks, "chunk_id")
    best = best_per_paper(hits.select("chunk_id", "paper_id", "section", "text", F.round("score", 4).alias("score")), limit)
    titles = papers.select(F.col("id").alias("paper_id"), "title")
    return best.join(titles, "paper_id", "left").select("paper_id", "title", "score", "section", snippet(F.col("text"), query_terms(query.lower())).alias("snippet"))


def search_titles(papers: DataFrame, query: str) -> DataFrame:
    """Papers whose title holds a word that begins with, or is nearly, a word of the query.

    Words over five letters may differ by a fifth of their length, over three by a tenth.
    """
    words = tokens(F.coalesce("title", F.lit("")))
    score = F.lit(0)
    for t in query_terms(query.lower()):
        score = score + F.exists(words, _near(t)).cast("int")
    return papers.withColumn("matches", score).where("matches > 0").select("id", "title", "matches").orderBy(F.desc("matches"), "id")


def _near(term: str):
    slack = round(len(term) * (0.2 if len(term) > 5 else 0.1 if len(term) > 3 else 0))
    return lambda w: F.startswith(w, F.lit(term)) | (F.levenshtein(w, F.lit(term)) <= slack)


def read_window(text: Column, offset: Column, window: Column, most: int = 20_000) -> Column:
    """A stretch of a text and where the next begins (null at the end)."""
    size = F.greatest(F.lit(1), F.least(window, F.lit(most)))
    start = F.greatest(offset, F.lit(0))
    total = F.length(text)
    return F.struct(F.substring(text, start + 1, size).alias("text"), F.when(start + size < total, start + size).alias("next_offset"), total.alias("total"))


def cited(answers: DataFrame, text_column: str, allowed: Column) -> DataFrame:
    """Splits the ids an answer cites into those among the evidence and the others, and takes the others out of the text."""
    ids = F.array_distinct(tx.citations(F.col(text_column)))
    kept, dropped = F.array_intersect(ids, allowed), F.array_except(ids, allowed)
    text = F.aggregate(F.transform(dropped, lambda i: F.concat(F.lit("[#"), i.cast("string"), F.lit("]"))), F.col(text_column), lambda t, mark: F.replace(t, mark, F.lit("")))
    return answers.select("*", kept.alias("cited"), dropped.alias("refused"), text.alias("clean_text"))


def hit_ranks(hits: DataFrame, key: str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id")))
