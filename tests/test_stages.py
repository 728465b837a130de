"""Files through all stages, with fake models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.operators import search, stages
from lectern.sources.library import scan_library

PROSE = "The orbit of the small probe was held at 705 km for the whole year, and nothing failed. " * 6 + "It weighed 12 kg before the long flight. The dose was 12 RJ at the end of it."
TEXT = f"# Orbits of Small Probes\nAuthor: Ada Bee and Carl Dee\nYear: 1999\n\n## Abstract\n\n{PROSE}\n\n## Method\n\n{PROSE}\n\n## References\n\n{PROSE}\n"


def ask():
    def answer(prompt: str) -> str | None:
        if prompt.startswith("Choose"):
            return json.dumps({"tags": ["Space", "unknown", "space"], "proposed_tags": ["Small Probe"]})
        if prompt.startswith("Is the token"):
            return json.dumps({"quantity_kind": "not_a_quantity", "confident": True})
        if "Title: Orbits" in prompt:
            return json.dumps({"genre": "technical-report", "question": "How long does it hold?", "argument": "It holds well.", "significance": "It is cheap.", "claims": ["The orbit holds all year"], "entities": []})
        raise RuntimeError("no such model")

    return answer


def test_files_to_readings(spark, tmp_path):
    (tmp_path / "a.md").write_text(TEXT)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 broken")
    parsed = stages.parse_stage(scan_library(spark, str(tmp_path))).cache()
    assert {r.path.rpartition("/")[2]: r.status for r in parsed.collect()} == {"a.md": "parsed", "b.pdf": "failed", "c.docx": "failed"}
    papers = stages.metadata_stage(parsed).cache()
    row = papers.first()
    assert (row.title, row.authors, row.year, row.work_key) == ("Orbits of Small Probes", ["Ada Bee", "Carl Dee"], 1999, "title:orbits-of-small-probes|bee")
    assert row.field_sources["abstract"] == "heuristic" and row.abstract.startswith("The orbit")

    vectors, chunk_rows = stages.embed_stage(papers)
    assert vectors.count() == 1 and {r.section for r in chunk_rows.collect()} == {"Abstract", "Method"}
    quantities, pending = stages.extract_stage(chunk_rows)
    kinds = {(r.section, r.quantity_kind) for r in quantities.collect()}
    assert ("Method", "length") in kinds and ("Method", "mass") in kinds and pending.first().pending >= 1
    settled = stages.adjudicate_stage(quantities, ask).collect()
    assert settled and all(r.new_status == "rejected" for r in settled)

    tags = stages.tag_stage(papers, ["space", "time"], ask).first()
    assert (tags.tags, tags.proposed) == (["space"], ["small-probe"])
    reading = stages.insight_stage(papers, ask).first().reading
    assert reading.genre == "technical-report" and reading.grounded and reading.claims == ["The orbit holds all year"]
    assert stages.insight_stage(papers.withColumn("title", F.lit("Other")), ask).count() == 0

    index = search.postings(chunk_rows.select(F.col("ord").alias("chunk_id"), "section", "text"), stemmed=True)
    assert search.search(index, "orbiting weigh", stemmed=True).count() == 2
    again = stages.replace_rows(chunk_rows, chunk_rows.limit(1), "digest")
    assert again.count() == 1


def test_lookups_fill_and_log(spark):
    papers = spark.createDataFrame([(1, "Mine", None, {"title": "manual"}), (2, "Guess", None, {"title": "heuristic"})], "id long, title string, venue string, field_sources map<string, string>")
    found = spark.createDataFrame([(1, "Theirs", "V"), (2, "Better", "W")], "id long, title string, venue string")
    out, log = stages.lookup_stage(papers, found, "id", ["title", "venue"])
    rows = {r.id: r for r in out.collect()}
    assert (rows[1].title, rows[1].venue, rows[1].field_sources) == ("Mine", "V", {"title": "manual", "venue": "crossref"})
    assert (rows[2].title, rows[2].field_sources["title"]) == ("Better", "crossref") and log.count() == 2
