"""The stages that take a file to everything known of it, each a function from tables to tables.

A stage replaces all it had said of a paper before; a lost run is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import measures
from ..functions import text as tx
from ..sources.documents import parse_documents
from . import chunks, encode, metadata, review

#: A prompt to an answer in JSON, or None where the model fails.
Ask = Callable[[str], str | None]


def replace_rows(table: DataFrame, fresh: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
    """The table after all rows of the papers in ``done`` (those of ``fresh`` unless given) were replaced."""
    keys = (fresh if done is None else done).select(key).distinct()
    return table.join(keys, key, "left_anti").unionByName(fresh)


def parse_stage(files: DataFrame, page_limit: int = 0) -> DataFrame:
    """Files (path, kind, content, digest) with Markdown, the gate's verdict and a status; unreadable ones are failed."""
    rows = parse_documents(files, page_limit).drop("content")
    rows = tx.with_quality(rows, F.coalesce("markdown", F.lit("")), F.coalesce("pages", F.lit(1)), F.lit(0.0), F.lit(1))
    status = F.when(F.col("problem").isNotNull(), "failed").otherwise("parsed")
    return rows.withColumn("passed", (F.size("hard") == 0) & (F.size("soft") < 2)).withColumn("status", status)


def metadata_stage(parsed: DataFrame) -> DataFrame:
    """Readable documents with title, authors, abstract, identifiers, year, provenance and work key."""
    named = parsed.where("status = 'parsed'").withColumnsRenamed({"title": "embedded_title", "authors": "embedded_authors", "year": "embedded_year"})
    source = F.when(F.col("kind") == "epub", "ebook_embedded").otherwise("pdf_embedded")
    found = metadata.extract_metadata(named.withColumn("embedded_source", source))
    author = F.get("authors", F.lit(0))
    return found.drop("embedded_title", "embedded_authors", "embedded_year", "embedded_source").withColumn("work_key", tx.work_key(F.col("doi"), F.col("arxiv_id"), F.col("title"), author, F.col("digest")))


def embed_stage(papers: DataFrame, key: str = "digest", factory=encode.hashed_words) -> tuple[DataFrame, DataFrame]:
    """(vectors of documents, chunks): one vector a document, of its title, abstract and headings."""
    rows = papers if "summary" in papers.columns else papers.withColumn("summary", F.lit(None).cast("string"))
    texts = chunks.document_texts(rows, key).join(rows.select(key, "markdown"), key)
    vectors = encode.encode_documents(texts.select(key, encode.text_for_vector(F.col("text"), F.col("markdown")).alias("text")), "text", factory).drop("text")
    return vectors, chunks.chunk_markdown(rows, key)


def extract_stage(chunk_rows: DataFrame, key: str = "digest") -> tuple[DataFrame, DataFrame]:
    """(quantities with their chunk and section; papers whose pending rows call for a verdict)."""
    rows = measures.extract_quantities(chunk_rows.withColumnRenamed("ord", "chunk_ord"), "text", [key, "chunk_ord", "section"])
    pending = rows.where("status = 'pending_llm'").groupBy(key).agg(F.count(F.lit(1)).alias("pending"))
    return rows, pending


def ask_model(rows: DataFrame, prompt: Column, factory: Callable[[], Ask], out: str = "answer") -> DataFrame:
    """Adds a model's JSON answers; the client is made once per worker, a failed call is a null."""

    @F.pandas_udf(StringType())
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = factory()

        def tried(p: str | None) -> str | None:
            try:
                return None if p is None else ask(p)
            except Exception:  # noqa: BLE001 - one bad call is one null
                return None

        for prompts in parts:
            yield prompts.map(tried)

    return rows.withColumn(out, answers(prompt))


def tag_prompt(title: Column, abstract: Column, vocabulary: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("Choose up to six tags for this work from the list, and propose up to two new ones only if none fits."),
        F.concat(F.lit("Tags: "), F.array_join(vocabulary, ", ")),
        F.concat(F.lit("Title: "), F.coalesce(title, F.lit("(none)"))),
        F.concat(F.lit("Abstract: "), F.substring(F.coalesce(abstract, F.lit("(none)")), 1, 2500)),
    )


def reading_prompt(title: Column, authors: Column, year: Column, abstract: Column, headings: Column, excerpt: Column) -> Column:
    """What is asked for a plain reading of a work: six thousand characters at most."""
    parts = (
        F.lit("Say in plain words what question this work asks, what it argues, and why that matters; name its genre, up to four claims and up to eight things."),
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Authors: "), F.array_join(F.slice(authors, 1, 4), ", ")),
        F.concat(F.lit("Year: "), year.cast("string")),
        F.concat(F.lit("Abstract: "), F.substring(abstract, 1, 2500)),
        F.concat(F.lit("Headings: "), F.array_join(F.slice(headings, 1, 20), "; ")),
        F.concat(F.lit("Opening: "), F.substring(excerpt, 1, 1800)),
    )
    return F.substring(F.concat_ws("\n", *parts), 1, 6000)


def verdict_prompt(sentence: Column, number: Column, token: Column) -> Column:
    return F.concat_ws("\n", F.lit("Is the token a unit of measurement here? Give the quantity's kind, or not_a_quantity, the unit, and whether you are sure."), F.concat(F.lit("Sentence: "), sentence), F.concat(F.lit("Number: "), number), F.concat(F.lit("Token: "), token))


def tag_stage(papers: DataFrame, vocabulary: list[str], factory: Callable[[], Ask], key: str = "digest") -> DataFrame:
    """(key, tags, proposed): from answers {"tags": [...], "proposed_tags": [...]}; no answer gives no tags."""
    words = F.array(*[F.lit(v) for v in vocabulary])
    asked = ask_model(papers.select(key, "title", "abstract"), tag_prompt(F.col("title"), F.col("abstract"), words), factory)
    a = F.from_json("answer", "struct<tags: array<string>, proposed_tags: array<string>>")
    none = F.array().cast("array<string>")
    return asked.select(key, review.normal_tags(F.coalesce(a["tags"], none), words).alias("tags"), review.normal_proposals(F.coalesce(a["proposed_tags"], none), words).alias("proposed"))


def insight_stage(papers: DataFrame, factory: Callable[[], Ask], key: str = "digest") -> DataFrame:
    """(key, reading) of works the model could read."""
    heads = F.filter(F.transform(chunks.sections(F.col("markdown")), lambda s: s["title"]), lambda t: t.isNotNull())
    prompt = reading_prompt(F.col("title"), F.col("authors"), F.col("year"), F.col("abstract"), heads, metadata.excerpt_of("markdown"))
    asked = ask_model(papers.withColumn("_prompt", prompt).select(key, "_prompt"), F.col("_prompt"), factory)
    return asked.where(F.col("answer").isNotNull()).select(key, review.normal_reading(F.col("answer")).alias("reading"))


def adjudicate_stage(quantities: DataFrame, factory: Callable[[], Ask]) -> DataFrame:
    """Pending rows settled by a model's verdicts."""
    pending = quantities.where("status = 'pending_llm'")
    asked = ask_model(pending, verdict_prompt(F.col("context_sentence"), F.col("value_original"), F.col("unit_original")), factory)
    a = F.from_json("answer", "struct<quantity_kind: string, unit: string, confident: boolean>")
    verdicts = asked.withColumns({"verdict_kind": a["quantity_kind"], "verdict_unit": a["unit"], "confident": a["confident"]})
    return measures.apply_verdict(verdicts.drop("answer"))


def lookup_stage(papers: DataFrame, found: DataFrame, key: str, fields: list[str], service: str = "crossref") -> tuple[DataFrame, DataFrame]:
    """(enriched papers, log): fields filled from a lookup table in place of a call to the service; each use is logged."""
    log = papers.join(found.select(key), key, "left_semi").select(key, F.lit(service).alias("service"), F.current_timestamp().alias("at"))
    return metadata.enrich(papers, found, key, fields, service), log
