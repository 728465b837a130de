"""Queries over texts: pages to chunks, quality, identity, measures, search, metadata, jobs, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, measures
from ..functions import text as tx
from ..functions.partitions import spread
from ..functions.tables import run_dir
from ..operators import catalog, chunks, index, jobs, metadata, review, search
from ..sources import html, library as files
from ..sources.documents import parse_documents
from ..streaming import ingest
from . import sql
from .base import cte, library, query, table
from .catalog import UNITS_SQL

P, J, Q = "papers", "jobs", "quantities"


# --- pages, sections, chunks ---------------------------------------------------------


def _markdown(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", html.markdown("html").alias("markdown"))


@query()
def flagship(spark, d):
    """Raw pages to Markdown to sections to retrieval chunks."""
    return chunks.chunk_markdown(_markdown(spark, d), "page_id")


@query()
def s13_html_to_markdown(spark, d):
    return _markdown(spark, d)


@query()
def x1_sections(spark, d):
    rows = _markdown(spark, d).select("page_id", F.posexplode(chunks.sections(F.col("markdown"))).alias("place", "s"))
    return rows.select("page_id", "place", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.length("s.body").alias("chars"))


@query()
def x3_chunks_of_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", F.col("text").alias("markdown")))
    return chunks.chunk_markdown(docs, "doc_id").select("doc_id", "ord", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query()
def x3_split_long_texts(spark, d):
    """Overlapping pieces of every whole text, in SQL."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, p.ord, p.text FROM {docs} AS t, LATERAL split_long(t.text) AS p", docs=spread(table(spark, d, "documents").select("doc_id", "text")))


@query()
def x5_document_texts(spark, d):
    pages = _markdown(spark, d).withColumn("title", F.concat(F.lit(" Page "), F.col("page_id").cast("string"))).withColumn("abstract", F.lit(None).cast("string")).withColumn("summary", F.lit(""))
    return chunks.document_texts(pages, "page_id")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id, ['References', 'appendix A', ' Acknowledgments', 'Methods', 'Conflict of Interest', 'Funding'][(doc_id % 6 + 1)::INT] || ' ' || left(text, 20) FROM documents)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[ \\t\\n\\x0B\\f\\r]*(references|bibliography|acknowledge?ments?|appendix|supplementary|funding|author contributions|conflicts? of interest|declaration)', 'i')) AS boilerplate FROM h GROUP BY 1"""
)
def x2_boilerplate_headings(spark, d):
    """Every line of every text, and one heading made from each, as a heading."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    made = F.concat(F.get(F.array(*map(F.lit, ("References", "appendix A", " Acknowledgments", "Methods", "Conflict of Interest", "Funding"))), F.col("doc_id") % 6), F.lit(" "), F.substring("text", 1, 20))
    lines = docs.select("doc_id", F.explode(F.concat(F.split("text", "\n"), F.array(made))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(tx.boilerplate_heading(F.col("line"))).alias("boilerplate"))


@query("SELECT doc_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS tokens, CAST(greatest(1, round_even(n_chars / 1800, 0)) AS INTEGER) AS pages FROM documents")
def x4_tokens_and_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), tx.pages_of(F.col("n_chars")).alias("pages"))


# --- quality gate -------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
METRICS = f"""t AS (SELECT doc_id, coalesce(text, '') AS x, greatest(1, round_even(n_chars / 1800, 0)) AS pages FROM documents),
    w AS (SELECT *, length(x) AS n, list_filter(list_transform(regexp_split_to_array(x, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: trim(l, chr(9) || ' ' || chr(160))), lambda l: length(l) >= 20) AS lines,
      list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda y: replace(lower(y), 'ß', 'ss')) AS words FROM t),
    m AS (SELECT doc_id, n / pages AS cpp, CASE WHEN len(lines) >= 5 THEN len(list_filter(lines, lambda l: NOT contains(l, ' '))) / len(lines) ELSE 0 END AS mws,
      len(regexp_extract_all(x, '\\p{{L}}')) / greatest(n, 1) AS alpha, len(regexp_extract_all(x, '[^\\x00-\\x7F]')) / greatest(n, 1) AS nonascii,
      len(list_filter(words, lambda y: y IN ({_STOP}))) / greatest(len(words), 1) AS stop, coalesce(list_sum(list_transform(words, lambda y: length(y))), 0) / greatest(len(words), 1) AS mean,
      len(regexp_extract_all(x, '[\\x{{FFFD}}\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{{9F}}]')) / greatest(n, 1) AS bad FROM w)"""


def _rated(spark, d):
    return tx.with_quality(spread(table(spark, d, "documents").select("doc_id", "text", "n_chars")), F.coalesce("text", F.lit("")), tx.pages_of(F.col("n_chars")), F.lit(0.0), F.lit(0))


@query(f"WITH {METRICS} SELECT doc_id, round(cpp, 4) AS chars_per_page, round(mws, 6) AS missing_whitespace, round(alpha, 6) AS alpha, round(nonascii, 6) AS nonascii, round(stop, 6) AS stopwords, round(mean, 6) AS mean_word, round(bad, 6) AS replacement FROM m")
def x6_quality_metrics(spark, d):
    names = {"chars_per_page": "chars_per_page", "missing_whitespace": "missing_whitespace_ratio", "alpha": "alpha_ratio", "nonascii": "nonascii_ratio", "stopwords": "stopword_hit_rate", "mean_word": "mean_word_length", "replacement": "replacement_ratio"}
    return _rated(spark, d).select("doc_id", *[F.round(F.col("metrics")[v], 4 if k == "chars_per_page" else 6).alias(k) for k, v in names.items()])


@query(
    f"""WITH {METRICS}, h AS (SELECT doc_id, list_filter([CASE WHEN cpp < 200 THEN 'insufficient_text' END, CASE WHEN mws > 0.3 THEN 'missing_whitespace' END, CASE WHEN bad > 0.01 THEN 'replacement_characters' END, CASE WHEN alpha < 0.35 THEN 'not_word_like' END, CASE WHEN cpp < 200 THEN 'no_text_layer' END], lambda r: r IS NOT NULL) AS hard,
    list_filter([CASE WHEN stop < 0.06 THEN 'few_function_words' END, CASE WHEN nonascii > 0.06 THEN 'unusual_alphabet' END, CASE WHEN NOT mean BETWEEN 2.5 AND 12 THEN 'odd_word_lengths' END], lambda r: r IS NOT NULL) AS soft FROM m)
    SELECT doc_id, len(hard) = 0 AND len(soft) < 2 AS passed, round(greatest(0, least(1, 1 - 0.34 * len(hard) - 0.15 * len(soft)))::DOUBLE, 4) AS score, array_to_string(list_concat(hard, CASE WHEN len(soft) >= 2 THEN soft ELSE [] END), ',') AS reasons FROM h"""
)
def x7_quality_gate(spark, d):
    rows = _rated(spark, d)
    two = F.size("soft") >= 2
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - fixed.GATE["hard_cost"] * F.size("hard") - fixed.GATE["soft_cost"] * F.size("soft")))
    reasons = F.array_distinct(F.concat("hard", F.when(two, F.col("soft")).otherwise(F.array().cast("array<string>"))))
    return rows.select("doc_id", ((F.size("hard") == 0) & ~two).alias("passed"), F.round(score, 4).alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query(
    cte(P)
    + """, a AS (SELECT id, t.tier, t.tier = 2 OR (id + t.tier) % 4 = 0 AS passed, concat(title, repeat('x', CAST((id * (t.tier + 3)) % 17 AS INTEGER))) AS text FROM papers, (VALUES (0), (1), (2)) AS t(tier) WHERE t.tier < 2 OR id % 2 = 0),
    g AS (SELECT id, min(tier) FILTER (passed) AS good, max(tier) AS high FROM a GROUP BY 1) SELECT id, coalesce(good, high) AS tier, good IS NULL AS degraded FROM g"""
)
def s14_best_attempt(spark, d):
    p = library(spark, d, P).select("id", "title").withColumn("tier", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("tier < 2 OR id % 2 = 0")
    a = p.select("id", "tier", ((F.col("tier") == 2) | ((F.col("id") + F.col("tier")) % 4 == 0)).alias("passed"), F.concat(F.coalesce("title", F.lit("")), F.repeat(F.lit("x"), ((F.col("id") * (F.col("tier") + 3)) % 17).cast("int"))).alias("text"))
    return review.best_attempt(a, "id").select("id", "tier", "degraded")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE least(doc_id, 80) END AS budget, doc_id % 3 <> 0 AND doc_id > 80 AS cut, CASE WHEN doc_id % 3 <> 0 AND doc_id > 80 THEN doc_id::INTEGER END AS total FROM documents")
def s15_page_limits(spark, d):
    docs = table(spark, d, "documents")
    limit = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.lit(80))
    budget = tx.page_budget(F.col("doc_id"), limit)
    noted = tx.with_truncation_note(F.lit("body  "), budget, F.col("doc_id"))
    return docs.select("doc_id", budget.alias("budget"), tx.was_truncated(noted).alias("cut"), tx.full_length(noted).alias("total"))


# --- identity and metadata ------------------------------------------------------------------


@query(cte(P) + "SELECT id, CASE WHEN doi IS NULL THEN NULL ELSE lower(regexp_replace(regexp_extract(doi, '(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,;)\\]]+$', '')) END AS doi, CASE WHEN arxiv_id IS NULL THEN NULL ELSE regexp_replace(replace(lower(arxiv_id), 'arxiv:', ''), 'v[0-9]+$', '') END AS arxiv FROM papers")
def x10_identifiers(spark, d):
    return library(spark, d, P).select("id", tx.normal_doi(F.col("doi")).alias("doi"), tx.normal_arxiv(F.col("arxiv_id")).alias("arxiv"))


@query(
    cte(P)
    + """, k AS (SELECT id, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(regexp_replace(regexp_extract(doi, '(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,;)\\]]+$', ''))
    WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || regexp_replace(replace(lower(arxiv_id), 'arxiv:', ''), 'v[0-9]+$', '')
    WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') <> '' THEN 'title:' || left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 80) || '|l' || (id % 9) || 'velace'
    ELSE 'sha256:' || sha256(path) END AS work_key FROM papers) SELECT * FROM k"""
)
def x11_work_keys(spark, d):
    return catalog.work_keys(library(spark, d, P)).select("id", "work_key")


@query(cte(P) + "SELECT id, 'Ada L' || (id % 9) || 'velace|B. Turing' AS names FROM papers")
def x13_split_authors(spark, d):
    return library(spark, d, P).select("id", F.array_join(tx.split_authors(F.col("authors")), "|").alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2000 + CAST(doc_id % 50 AS INTEGER) END AS year, CASE WHEN doc_id % 2 = 1 AND doc_id % 2100 BETWEEN 1 AND 2049 THEN CAST(doc_id % 2100 AS INTEGER) END AS labelled FROM documents")
def x19_years(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.format_string("Printed 1985 and again (%d), not 1879 or 2051.", 2000 + F.col("doc_id") % 50)).otherwise(F.format_string("Title\n**Year:** %d\nText", F.col("doc_id") % 2100))
    odd = F.col("doc_id") % 2 == 1
    return docs.select("doc_id", F.when(~odd, tx.find_year(text)).alias("year"), F.when(odd, tx.front_year(text)).alias("labelled"))


@query()
def x15_metadata(spark, d):
    found = metadata.extract_metadata(_markdown(spark, d))
    return found.select("page_id", "title", "abstract", "doi", "year", F.array_join("authors", "|").alias("authors"), F.to_json("field_sources").alias("sources"))


@query("SELECT doc_id, length(text) >= 200 AND NOT regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(#|>|- |\\p{Ll})') AS candidate FROM documents WHERE text IS NOT NULL")
def x22_prose_candidates(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", ((F.length("text") >= 200) & ~tx.squeeze(F.col("text")).rlike(r"^(#|>|- |\p{Ll})")).alias("candidate"))


@query(
    rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT *, string_split(t, ' ') AS ws FROM s)
    SELECT doc_id, coalesce(length(t) >= 200 AND NOT regexp_matches(t, '^(?:#|>|- )') AND NOT regexp_matches(substr(t, 1, 200), '{fixed.NOTICE}') AND NOT regexp_matches(t, '{fixed.CAPTION}')
      AND NOT regexp_matches(t, '{fixed.TABLE_ROW}') AND NOT regexp_matches(t, '^\p{{Ll}}') AND len(regexp_extract_all(t, '{fixed.SENTENCE_END}')) >= 2
      AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}')))::DOUBLE / len(ws) < 0.4 AND len(list_filter(ws, lambda x: regexp_matches(x, '\p{{Nd}}')))::DOUBLE / len(ws) < 0.15, FALSE) AS prose FROM w"""
)
def x22_is_prose(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.coalesce(tx.is_prose(F.col("text")), F.lit(False)).alias("prose"))


@query(
    """WITH w AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{4,}') AS s FROM documents)),
    g AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM w WHERE term NOT IN ("""
    + _STOP
    + """) GROUP BY 1, 2) SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g) WHERE rank <= 40"""
)
def a7_topic_terms(spark, d):
    return catalog.topic_terms(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query()
def x24_synopsis(spark, d):
    rows = _markdown(spark, d).select("page_id", metadata.synopsis_of("markdown").alias("s"), metadata.excerpt_of("markdown").alias("excerpt"))
    return rows.select("page_id", "s.strategy", F.length("s.text").alias("chars"), F.length("excerpt").alias("excerpt_chars"))


@query(cte(P) + "SELECT id, CASE WHEN id % 3 = 0 AND (year IS NULL OR id % 2 = 0) THEN 1900 ELSE year END AS year, CASE WHEN id % 3 = 0 AND (year IS NULL OR id % 2 = 0) THEN 'crossref' WHEN id % 2 = 0 THEN 'heuristic' ELSE 'manual' END AS origin FROM papers")
def x21_enrich(spark, d):
    p = library(spark, d, P).select("id", F.col("year").cast("long").alias("year"), F.create_map(F.lit("year"), F.when(F.col("id") % 2 == 0, "heuristic").otherwise("manual")).alias("field_sources"))
    found = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(1900).cast("long").alias("year"))
    return metadata.enrich(p, found, "id", ["year"]).select("id", "year", F.try_element_at("field_sources", F.lit("year")).alias("origin"))


# --- measures ------------------------------------------------------------------------------------


def _sentences(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", F.concat(F.lit("The sampled part measured "), F.col("p_size").cast("string"), F.lit(" mm across its widest face. It weighs "), F.col("p_size").cast("string"), F.lit(".5 kg and runs at -3 °C for 12 parts.")).alias("text"))


@query("""SELECT p_partkey, 'length' AS quantity_kind, round(p_size * 0.001::DOUBLE, 9) AS value_si, 'mm' AS unit_original FROM part UNION ALL SELECT p_partkey, 'mass', round(p_size + 0.5::DOUBLE, 9), 'kg' FROM part UNION ALL SELECT p_partkey, 'temperature', 270.15::DOUBLE, '°C' FROM part""")
def q6_extract_quantities(spark, d):
    found = measures.extract_quantities(_sentences(spark, d), "text", ["p_partkey"])
    return found.select("p_partkey", "quantity_kind", F.round("value_si", 9).alias("value_si"), "unit_original")


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])[\\s\\x0B\\x{85}\\p{Z}]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s FROM documents),
    t AS (SELECT doc_id, regexp_replace(s, '^[\\s\\x0B\\x{85}\\p{Z}]+|[\\s\\x0B\\x{85}\\p{Z}]+$', '', 'g') AS s FROM p WHERE contains(s, ' '))
    SELECT doc_id, count(*) FILTER (length(s) BETWEEN 25 AND 500 AND NOT contains(s, '<br>') AND NOT contains(s, '<!--') AND NOT contains(s, '|')) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1"""
)
def q1_sentences(spark, d):
    """How many sentences every whole text has."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_size(measures.sentences(F.col("text"))), F.lit(0)).cast("long").alias("n"))


@query()
def q6_document_quantities(spark, d):
    """Every measured value of every whole text, and of a sentence inside each that has one."""
    units = F.get(F.array(*map(F.lit, ("mm", "kg", "°C", "GHz", "ms", "furlongs", "km"))), F.col("doc_id") % 7)
    said = F.concat(F.lit(" It took about "), F.col("n_chars").cast("string"), F.lit(".5 "), units, F.lit(" across the whole of it. "))
    text = F.concat(F.substring("text", 1, 300), said, F.substring("text", 301, 1 << 30))
    found = measures.extract_quantities(spread(table(spark, d, "documents").select("doc_id", text.alias("text"))), "text", ["doc_id"])
    return found.select("doc_id", "quantity_kind", F.round("value_si", 9).alias("value_si"), "value_original", "unit_original", "status")


@query(f"WITH {UNITS_SQL}, w AS (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM w GROUP BY 1) SELECT token, kind, factor, shift, unit_si, coalesce(n, 0) AS n FROM units LEFT JOIN n USING (token)")
def q3_units(spark, d):
    """The units that are known, and how often each stands in the texts as a word."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    units = measures.unit_table(spark).select("token", "kind", "factor", F.col("offset").alias("shift"), "unit_si")
    return units.join(words, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(cte(Q) + ", n AS (SELECT quantity_kind, count(*) AS n FROM quantities GROUP BY 1) SELECT quantity_kind, n, CASE quantity_kind WHEN 'length' THEN 'km' WHEN 'mass' THEN 't' WHEN 'time' THEN 'h' ELSE 'kHz' END AS symbol FROM n")
def q8_display_symbols(spark, d):
    n = library(spark, d, Q).groupBy("quantity_kind").agg(F.count(F.lit(1)).alias("n"))
    shown = measures.display(F.lit(7200.0), F.lit(None).cast("string"), F.col("quantity_kind"))
    return n.select("quantity_kind", "n", F.element_at(F.split(shown, " "), -1).alias("symbol"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'auto' ELSE 'pending_review' END AS new_status, CASE WHEN p_partkey % 5 = 1 THEN round(p_size * 1000.0, 6)::DOUBLE END AS new_value_si FROM part"""
)
def q7_verdicts(spark, d):
    k = F.col("p_partkey") % 5
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.when(k == 2, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" ± 2"))).alias("value_original"),
        F.when(k == 0, "not_a_quantity").when(k == 4, F.lit(None).cast("string")).otherwise("length").alias("verdict_kind"),
        F.lit("km").alias("verdict_unit"),
        (k != 3).alias("confident"),
    )
    return measures.apply_verdict(rows).select("p_partkey", "new_status", F.round("new_value_si", 6).alias("new_value_si"))


# --- search ---------------------------------------------------------------------------------------


def _chunks(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("paper_id"), F.col("lang").alias("section"), "text")


BM25 = """c AS (SELECT doc_id AS chunk_id, doc_id % 50 AS paper_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower(lang), '[\\p{L}\\p{N}]+')) AS t FROM documents),
    s AS (SELECT chunk_id, paper_id, len(t) AS size, len(list_filter(t, lambda w: starts_with(w, 'ther'))) AS f1, len(list_filter(t, lambda w: starts_with(w, 'and'))) AS f2 FROM c WHERE len(t) > 0),
    g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM s),
    h AS (SELECT chunk_id, paper_id, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * size / mean)) AS score FROM s, g WHERE f1 > 0 AND f2 > 0)"""


@query(f"WITH {BM25} SELECT chunk_id, round(score, 6) AS score FROM h")
def l2_bm25(spark, d):
    return search.scan(_chunks(spark, d), "ther* and").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, t AS (SELECT chunk_id, paper_id, round(score, 4) AS score FROM h), cut AS (SELECT * FROM t ORDER BY score DESC, chunk_id LIMIT 60), b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_id) AS r FROM cut) SELECT paper_id, score FROM b WHERE r = 1 ORDER BY score DESC, chunk_id LIMIT 20")
def l2_fulltext(spark, d):
    rows = _chunks(spark, d)
    return search.search_fulltext(rows, None, library(spark, d, P), "ther and", 20).select("paper_id", "score")


@query(f"WITH {BM25} SELECT chunk_id, round(score, 6) AS score FROM h")
def l2_inverted_index(spark, d):
    return search.search(search.postings(_chunks(spark, d)), "ther* and").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, t AS (SELECT chunk_id, round(score, 4) AS score FROM h) SELECT chunk_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 50")
def l2_index_top(spark, d):
    """The 50 best chunks from a written index."""
    made = index.build(_chunks(spark, d), f"{run_dir(spark)}/index")
    return index.top(made, "ther* and", 50)


@query(cte(P) + ", w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+') AS t FROM papers) SELECT id, 1 AS matches FROM w WHERE len(list_filter(t, lambda x: starts_with(x, 'theing') OR levenshtein(x, 'theing') <= 1)) > 0")
def l3_title_search(spark, d):
    return search.search_titles(library(spark, d, P), "theing").select("id", "matches")


@query("SELECT doc_id, substr(text, 101, 300) AS text, CASE WHEN length(text) > 400 THEN 400 END::INTEGER AS next_offset, length(text)::INTEGER AS total FROM documents")
def l4_read_window(spark, d):
    return table(spark, d, "documents").select("doc_id", search.read_window(F.col("text"), F.lit(100), F.lit(300)).alias("w")).select("doc_id", "w.text", "w.next_offset", "w.total")


@query("SELECT conv_id, turn, CAST(turn AS VARCHAR) AS cited, CAST(turn + 7 AS VARCHAR) AS refused, coalesce(text, '') || ' [#' || turn || '] ' || ' and' || coalesce(text, '') AS clean_text FROM conversations")
def l5_citation_gate(spark, d):
    """Every turn's text, with a citation that holds, one that doesn't, and the text again."""
    said = F.coalesce("text", F.lit(""))
    answer = F.concat(said, F.format_string(" [#%d] [#%d] and", F.col("turn"), F.col("turn") + 7), said)
    out = search.cited(table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer")), "answer", F.array(F.col("turn"), F.lit(-1).cast("long")))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("conv_id", "turn", ids("cited").alias("cited"), ids("refused").alias("refused"), "clean_text")


@query(
    """WITH t AS (SELECT doc_id, left(coalesce(text, ''), 120) || ' "a b" c:(d*)' AS q FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(q, '["^*():]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), lambda w: '"' || w || '"*'), ' ') AS expression FROM t"""
)
def l1_match_expression(spark, d):
    """The beginning of every text as a query, with some operators behind it."""
    asked = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 120), F.lit(' "a b" c:(d*)'))
    return table(spark, d, "documents").select("doc_id", search.match_expressions(asked).alias("expression"))


# --- jobs, streams ------------------------------------------------------------------------------------


@query(cte(J) + """, w AS (SELECT DISTINCT kind, paper_id FROM jobs WHERE state = 'done') SELECT w.kind, w.paper_id FROM w WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.state IN ('queued', 'running') AND j.kind = w.kind AND j.paper_id IS NOT DISTINCT FROM w.paper_id)""")
def k4_enqueue(spark, d):
    rows = library(spark, d, J)
    return jobs.enqueue(rows, rows.where("state = 'done'"))


@query(cte(J) + "SELECT id, state, CASE WHEN state <> 'running' THEN state WHEN attempts >= 3 THEN 'dead' ELSE 'queued' END AS new_state FROM jobs")
def k4_requeue_stale(spark, d):
    return jobs.requeue_stale(library(spark, d, J)).select("id", "state", "new_state")


@query(cte(J) + ", j AS (SELECT state, id // 2 AS paper_id FROM jobs) SELECT DISTINCT paper_id FROM j WHERE state = 'dead' AND paper_id NOT IN (SELECT paper_id FROM j WHERE state IN ('queued', 'running'))")
def e8_papers_to_fail(spark, d):
    return jobs.papers_to_fail(library(spark, d, J).withColumn("paper_id", F.floor(F.col("id") / 2)))


@query(cte(J) + "SELECT CAST(CASE kind WHEN 'parse' THEN 10 WHEN 'metadata' THEN 20 WHEN 'embed' THEN 30 WHEN 'extract' THEN 35 WHEN 'project' THEN 40 WHEN 'enrich' THEN 50 WHEN 'measure' THEN 90 WHEN 'adjudicate' THEN 95 WHEN 'tag' THEN 100 ELSE 101 END AS INTEGER) AS priority, kind, count(*) AS n FROM jobs WHERE state = 'queued' GROUP BY 1, 2")
def k5_drain_order(spark, d):
    return jobs.drain_order(library(spark, d, J))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS g FROM e) SELECT path, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY path, g""")
def k1_settled_paths(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return ingest.settled(rows, "3 hours").select("path", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query(
    cte(P)
    + """, f AS (SELECT p.path, sha256(coalesce(d.text, '')) AS digest, l.quality FROM papers p JOIN documents d ON d.doc_id = p.id LEFT JOIN labels l ON l.doc_id = p.id),
    k AS (SELECT digest, min(path) AS known_path, bool_or(quality = 1) AS present FROM f WHERE quality IS NOT NULL GROUP BY 1),
    a AS (SELECT DISTINCT CASE WHEN quality = 0 THEN path || '.moved' ELSE path END AS path, digest FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path) AS r FROM a)
    SELECT path, r.digest, CASE WHEN known_path IS NULL AND r = 1 THEN 'created' WHEN known_path = path THEN 'unchanged' WHEN known_path IS NOT NULL AND NOT present AND r = 1 THEN 'moved' ELSE 'duplicate_content' END AS outcome FROM r LEFT JOIN k ON k.digest = r.digest"""
)
def k3_register(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    p = library(spark, d, P).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(labels, "id", "left")
    f = p.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "quality")
    known = f.where("quality IS NOT NULL").select("path", "digest", (F.col("quality") == 1).alias("present"))
    arrived = f.select(F.when(F.col("quality") == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), "digest")
    return ingest.register(known, arrived)


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def k2_live_counts(spark, d):
    rows = ingest.live_counts(table(spark, d, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, CASE WHEN value > 50 THEN TRUE ELSE FALSE END AS active, value > 50 AND event_id % 2 = 0 AS acknowledged FROM events")
def k6_lease_state(spark, d):
    now = F.lit("2024-01-01 00:00:50").cast("timestamp")
    leases = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("nonce"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("acked"), F.when(F.col("value") > 50, now + F.expr("INTERVAL 1 SECOND")).otherwise(now).alias("until"))
    return review.lease_state(leases, now).select(F.col("nonce").cast("long").alias("event_id"), "active", "acknowledged")


# --- models, tags, formats -------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events) SELECT event_id, CASE WHEN k % 3 = 0 THEN 'survey-or-review' ELSE 'other' END AS genre, k % 2 = 0 AND k % 3 = 0 AS grounded,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS claims, 'Ada' AS entities, CASE WHEN k % 3 = 0 THEN 'Survey' END AS label FROM b"""
)
def n2_normal_reading(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.concat(
        F.when(k % 3 == 0, '{"genre": "survey-or-review", "question": "what is it", ').otherwise('{"genre": "poem", "question": "The central question or problem", '),
        F.when(k % 3 == 0, '"claims": ["one two three four", "one two three  four", "too short"], ').otherwise('"claims": null, '),
        F.lit('"argument": "because", "significance": "much", "entities": [{"name": "Ada", "kind": "Person"}, {"name": "ADA", "kind": "person"}, {"name": "x", "kind": "thing"}], "grounded": '),
        F.when(k % 2 == 0, "true}").otherwise("false}"),
    )
    rows = table(spark, d, "events").select("event_id", review.normal_reading(answer).alias("r"))
    return rows.select("event_id", "r.genre", "r.grounded", F.size("r.claims").alias("claims"), F.array_join(F.transform("r.entities", lambda e: e["name"]), ",").alias("entities"), review.genre_label(F.col("r.genre")).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'alpha,beta' ELSE 'beta' END AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'new-idea' ELSE '' END AS proposals FROM orders")
def n3_normal_tags(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    vocabulary = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    tags = F.when(even, F.array(F.lit(" Alpha"), F.lit("beta"), F.lit("alpha"), F.lit("delta"))).otherwise(F.array(F.lit("Beta")))
    proposals = F.when(even, F.array(F.lit("New Idea"), F.lit("beta"), F.lit("new  idea"))).otherwise(F.array(F.lit("  ")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(review.normal_tags(tags, vocabulary), ",").alias("tags"), F.array_join(review.normal_proposals(proposals, vocabulary), ",").alias("proposals"))


@query(
    """WITH p AS (SELECT vec_id + (CASE WHEN label < 4 THEN 0 ELSE 100000 END) AS id, CASE WHEN label < 7 THEN embedding::DOUBLE[] ELSE list_reverse(embedding::DOUBLE[]) END AS e FROM embeddings),
    n AS (SELECT p.id, max(list_cosine_similarity(p.e, k.embedding::DOUBLE[])) AS s, arg_max(k.vec_id, list_cosine_similarity(p.e, k.embedding::DOUBLE[])) AS other FROM p, embeddings k GROUP BY 1)
    SELECT 't' || id AS slug, CASE WHEN id < 100000 THEN 'existing' WHEN s >= 0.9 THEN 'merged' ELSE 'pending_review' END AS outcome, CASE WHEN id < 100000 THEN 't' || id WHEN s >= 0.9 THEN 't' || other END AS canonical FROM n"""
)
def n4_register_proposals(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    tags = v.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("slug"), "v")
    shifted = F.when(F.col("label") < 4, F.col("id")).otherwise(F.col("id") + 100000)
    proposals = v.select(F.concat(F.lit("t"), shifted.cast("string")).alias("slug"), F.when(F.col("label") < 7, F.col("v")).otherwise(F.reverse("v")).alias("v"))
    return review.register_proposals(proposals, tags)


@query("SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, 5), ' ') AS name FROM part")
def n5_region_names(spark, d):
    return table(spark, d, "part").select("p_partkey", review.region_name(F.concat(F.lit(' "'), "p_name", F.lit('". '))).alias("name"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'unproven' WHEN s_nationkey * 400 / s_acctbal > 0.9 THEN 'gpu' WHEN s_nationkey > 0 THEN 'partial' ELSE 'cpu_only' END AS verdict FROM supplier")
def n6_model_verdicts(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", review.model_verdict(F.col("s_acctbal"), F.col("s_nationkey") * 400).alias("verdict"))


@query("WITH m AS (SELECT o_custkey AS reference, max(o_totalprice) AS total FROM orders GROUP BY 1 UNION ALL SELECT -1, 7.0) SELECT coalesce(c_custkey, reference) AS reference, coalesce(total, c_acctbal) AS total FROM customer FULL JOIN m ON reference = c_custkey")
def n9_upsert_measurements(spark, d):
    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("reference"), F.col("c_acctbal").alias("total"), F.lit(1.0).alias("on_card"))
    measured = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("reference")).agg(F.max("o_totalprice").alias("total"), F.lit(1.0).alias("on_card"))
    return review.upsert_measurements(profiles, measured.unionByName(spark.createDataFrame([(-1, 7.0, 1.0)], measured.schema))).select("reference", "total")


@query("SELECT doc_id, printf('%03d/%06d.md', doc_id // 1000, doc_id) AS path FROM documents")
def y10_shard_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", files.shard_path(F.col("doc_id")).alias("path"))


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS until FROM events")
def d1_times(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.date_format(F.col("ts") + F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss").alias("until"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def n1_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_id, '{"a":"' || event_type || '","n":{"p":' || replace(props, ' ', '') || ',"x":[1,' || user_id || ']}}' AS canonical, true AS same, user_id = 1 AS lists_alike, json_valid(props) AS valid FROM events""")
def n1_payload_equality(spark, d):
    """Payloads of events: objects in two orders of keys are one payload, lists in two orders aren't, half a payload is none."""
    rows = table(spark, d, "events")
    said = F.concat(F.lit('"a": "'), "event_type", F.lit('"'))
    inner = [F.concat(F.lit('"p": '), "props"), F.concat(F.lit('"x": [1, '), F.col("user_id").cast("string"), F.lit("]"))]
    one = F.concat(F.lit("{"), said, F.lit(', "n": {'), inner[0], F.lit(", "), inner[1], F.lit("}}"))
    two = F.concat(F.lit('{"n":{'), inner[1], F.lit(","), inner[0], F.lit("},  "), said, F.lit("}"))
    lists = [F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")) for a, b in ((F.lit("1"), F.col("user_id").cast("string")), (F.col("user_id").cast("string"), F.lit("1")))]
    canonical = tx.canonical_json
    half = canonical(F.expr("substr(props, 1, length(props) - 1)")).isNull()
    return rows.select("event_id", canonical(one).alias("canonical"), canonical(one).eqNullSafe(canonical(two)).alias("same"), canonical(lists[0]).eqNullSafe(canonical(lists[1])).alias("lists_alike"), (canonical(F.col("props")).isNotNull() & half).alias("valid"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'size ' || p_size AS markdown, 1 AS pages, p_brand AS title, NULL AS problem FROM part")
def s9_pdf_text_layers(spark, d):
    # A file of one page per part, put together in the JVM and read like any other.
    said = lambda c: F.regexp_replace(F.col(c), r"([\\\\()])", r"\\\\$1")
    content = F.concat(F.lit("BT /F 10 Tf 72 700 Td ("), said("p_name"), F.lit(") Tj 0 -40 Td [(si) 10 (ze) -400 ("), F.col("p_size").cast("string"), F.lit(")] TJ ET"))
    objects = ("<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Kids[3 0 R]/Count 1>>", "<</Type/Page/Parent 2 0 R/Contents 4 0 R>>")
    head = "%PDF-1.4\n" + "".join(f"{k} 0 obj\n{x}\nendobj\n" for k, x in enumerate(objects, 1))
    file = F.concat(F.lit(head + "4 0 obj\n<<>>stream\n"), content, F.lit("\nendstream\nendobj\n5 0 obj\n<</Title("), said("p_brand"), F.lit(")>>\nendobj\ntrailer<</Root 1 0 R/Info 5 0 R>>"))
    files = spread(table(spark, d, "part").select("p_partkey", F.lit("pdf").alias("kind"), file.cast("binary").alias("content")))
    return parse_documents(files).select("p_partkey", "markdown", "pages", "title", "problem")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'djvu' WHEN page_id % 4 = 2 THEN 'markdown' END AS kind, CASE WHEN page_id % 4 = 3 THEN 'not a document' END AS problem FROM pages")
def s2_document_kinds(spark, d):
    k = F.col("page_id") % 4
    content = F.when(k == 0, "%PDF-1.7").when(k == 1, "AT&TFORM").otherwise("plain text").cast("binary")
    path = F.when(k == 2, "a/notes.MD").when(k == 3, "a/archive.zip").otherwise("a/misnamed.txt")
    return table(spark, d, "pages").select("page_id", files.document_kind(path, content).alias("kind"), files.upload_problem(path, F.lit(9), content).alias("problem"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'cannot open' ELSE 'no diagnosis was recorded' END AS reason FROM supplier")
def l6_readable_reasons(spark, d):
    error = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("FileDataError: cannot open File: b%d.pdf", F.col("s_suppkey")))
    return table(spark, d, "supplier").select("s_suppkey", tx.readable_reason(error, F.format_string("b%d.pdf", F.col("s_suppkey"))).alias("reason"))


@query(cte(Q) + "SELECT id, CASE WHEN chunk_ord = 1 THEN 'confirmed' WHEN chunk_ord = 2 THEN 'rejected' ELSE status END AS status FROM quantities")
def y9_review_writes(spark, d):
    from ..operators import facade

    rows = library(spark, d, Q)
    verdicts = rows.where("chunk_ord <= 2").select("id", F.when(F.col("chunk_ord") == 1, "confirmed").otherwise("rejected").alias("verdict")).distinct()
    return facade.review_writes(rows, verdicts).select("id", "status")


# --- answers to clients -----------------------------------------------------------------------------------


@query("SELECT 99 AS id, list_sort(list_distinct(list(slug)))[1] AS first_tag, count(DISTINCT slug) AS tags FROM (SELECT o_orderpriority AS slug FROM orders WHERE o_orderkey % 1000 = 99)")
def y2_paper_detail(spark, d):
    from ..operators import facade

    found = facade.get_paper(library(spark, d, P), 99, tags=library(spark, d, "paper_tags"))
    return found.select(F.lit(99).alias("id"), F.get("tags", F.lit(0)).alias("first_tag"), F.size("tags").cast("long").alias("tags"))


@query(
    """WITH p AS (SELECT j.vec_id AS id, list_cosine_similarity(i.embedding::DOUBLE[], j.embedding::DOUBLE[]) AS s FROM embeddings i, embeddings j WHERE i.vec_id = 7 AND j.vec_id <> 7)
    SELECT id, round(s, 4) AS similarity FROM p ORDER BY s DESC, id LIMIT 25"""
)
def y3_similar_papers(spark, d):
    from ..operators import facade

    return facade.similar_papers(library(spark, d, "vectors"), library(spark, d, P), 7, 99).select("id", "similarity")


def _regions(spark, d):
    v = library(spark, d, "vectors")
    return v.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("label", F.concat(F.lit("Region "), F.col("cluster").cast("string"))).withColumn("terms", F.array(F.lit("a")))


@query("SELECT label AS cluster, 'Region ' || label AS label, count(*) AS size FROM embeddings GROUP BY 1 ORDER BY 3 DESC, 1")
def y4_regions(spark, d):
    from ..operators import facade

    return facade.list_regions(_regions(spark, d)).select("cluster", "label", "size")


@query("SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM embeddings) AS on_map, (SELECT count(DISTINCT label) FROM embeddings) AS regions, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS tags")
def y4_overview(spark, d):
    from ..operators import facade

    found = facade.library_overview(library(spark, d, P), library(spark, d, "vectors"), _regions(spark, d), library(spark, d, "paper_tags"))
    return found.withColumn("tags", F.size("tags").cast("long"))


@query(
    cte(P)
    + """SELECT v.vec_id AS id, p.title, p.year, CASE WHEN p.id IS NULL THEN NULL ELSE 'Ada L' || (p.id % 9) || 'velace' END AS first_author, round((v.vec_id % 100)::DOUBLE / 100, 3) AS confidence
    FROM embeddings v LEFT JOIN papers p ON p.id = v.vec_id WHERE v.label = 3 ORDER BY coalesce(confidence, 0) DESC, lower(coalesce(p.title, '')), 1 LIMIT 15""".replace("ORDER BY coalesce(confidence, 0)", "ORDER BY (v.vec_id % 100)")
)
def y5_region_members(spark, d):
    from ..operators import facade

    return facade.region_members(library(spark, d, "vectors").select("id", "cluster", "strength"), library(spark, d, P), 3)


@query(
    cte(Q)
    + """, f AS (SELECT * FROM quantities WHERE status IN ('auto', 'confirmed') AND value_si BETWEEN 5000 AND 9000 AND quantity_kind = 'mass' AND (lower(unit_original) = 't' OR lower(unit_si) = 't') AND contains(lower(context), 'of f'))
    SELECT id, value_si, (SELECT count(*) FROM f) AS total, (SELECT count(DISTINCT paper_id) FROM f) AS papers FROM f ORDER BY value_si, id LIMIT 50"""
)
def y6_query_quantities(spark, d):
    from ..operators import facade

    return facade.query_quantities(library(spark, d, Q), "mass", "T", 5000, 9000, "of F", 50).select("id", "value_si", "total", "papers")


@query()
def y7_curriculum_of_a_region(spark, d):
    from ..operators import facade

    v = library(spark, d, "vectors")
    members = v.select("id", "cluster")
    return facade.get_curriculum("region 3", _regions(spark, d), members, library(spark, d, P), v).select("id", "title", "score", "place", "step")


@query(
    """WITH h AS (SELECT doc_id, text, regexp_extract(left(text, 90), '(?s)^(.*[.!?]) ', 1) AS w, regexp_extract(left(text, 90), '(?s)^(.+) ', 1) AS x FROM documents)
    SELECT doc_id, CASE WHEN length(text) <= 90 THEN text WHEN length(w) > 31 THEN w ELSE regexp_replace(CASE WHEN length(x) > 0 THEN x ELSE left(text, 90) END, '[,;:]+$', '') || '…' END AS cut FROM h"""
)
def x26_sentence_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sentence_cut(F.col("text"), 90).alias("cut"))


@query("SELECT doc_id, '10.1234/x.' || doc_id AS doi, '2101.' || (10000 + doc_id) AS arxiv FROM documents")
def x12_find_identifiers(spark, d):
    """Identifiers inside the texts' own prose: a sentence of them stands after the first 700 characters."""
    said = F.format_string(" See arXiv: 2101.%d and doi 10.1234/X.%d). ", F.col("doc_id") + 10000, F.col("doc_id"))
    text = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 700), said, F.substring(F.coalesce("text", F.lit("")), 701, 1 << 30))
    return table(spark, d, "documents").select("doc_id", tx.find_doi(text).alias("doi"), tx.find_arxiv(text).alias("arxiv"))


@query("SELECT doc_id, list_max(list_transform(regexp_extract_all(left(text, 4000), '\\b(19[89]\\d|20[0-4]\\d)\\b', 1), lambda y: y::INTEGER)) AS year FROM documents")
def x19_years_of_texts(spark, d):
    """The latest year that every text names at its beginning."""
    return table(spark, d, "documents").select("doc_id", tx.find_year(F.col("text")).alias("year"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'The ' || p_name || ' of Things' END AS title FROM part")
def x16_embedded_titles(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.format_string("%d_scanfinal", F.col("p_partkey"))).otherwise(F.concat(F.lit("# **The "), "p_name", F.lit(" of Things**")))
    return table(spark, d, "part").select("p_partkey", tx.embedded_title(raw).alias("title"))


@query("SELECT page_id, 648 + length(CAST(page_id AS VARCHAR)) AS chars FROM pages")
def x28_opening_window(spark, d):
    long = F.concat(F.repeat(F.lit("abc de. "), 40), F.lit("\nwrapped "), F.col("page_id").cast("string"))
    text = F.concat_ws("\n\n", F.lit("*** START OF IT ***"), F.lit("Title"), long, F.repeat(F.lit("x"), 318), F.repeat(F.lit("y"), 900), F.lit("*** END OF IT ***"), F.lit("licence"))
    window = tx.opening_window(text, 700, begin_mark=r"\*\*\* START[^\n]*", end_mark=r"\*\*\* END")
    return table(spark, d, "pages").select("page_id", F.length(window).cast("long").alias("chars"))


@query(cte(P) + "SELECT id, '.quarantine/20240102/' || id || '.txt' AS target FROM papers")
def s20_quarantine_report(spark, d):
    from ..operators import facade

    rows = library(spark, d, P).select("id", "path", F.lit("duplicate").alias("problem"), F.lit(None).cast("string").alias("keeper"))
    out = facade.quarantine_report(rows.drop("id"), F.date_format(F.lit("2024-01-02").cast("timestamp"), "yyyyMMdd"))
    return out.join(rows.select("id", "path"), "path").select("id", "target")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'query: ' ELSE '' END AS instruction, 'base-e5-' || p_partkey AS store FROM part")
def e2_query_instructions(spark, d):
    model = F.when(F.col("p_partkey") % 2 == 0, F.format_string("base/E5-%d", F.col("p_partkey")))
    return table(spark, d, "part").select("p_partkey", review.query_instruction(F.coalesce(model, F.lit("other"))).alias("instruction"), tx.slug(F.format_string("Base/E5 %d!", F.col("p_partkey"))).alias("store"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Titled' ELSE left(text, 2000) END AS text FROM documents")
def e5_text_for_vector(spark, d):
    from ..operators.encode import text_for_vector

    composed = F.when(F.col("doc_id") % 2 == 0, "Titled").otherwise("  ")
    return table(spark, d, "documents").select("doc_id", text_for_vector(composed, F.col("text")).alias("text"))


@query()
def v3_semantic_search(spark, d):
    from ..operators import encode, facade

    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    vectors = encode.encode_documents(docs, "text").select("id", "v")
    return facade.search_library(library(spark, d, P), "semantic", "", 10, vectors=vectors, query_vector=encode.encode_query("anti ther inon"))


@query("SELECT event_type AS quantity_kind, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 25 AS batch, event_id AS id FROM events")
def k9_adjudication_batches(spark, d):
    from ..operators import facade

    rows = table(spark, d, "events").selectExpr("event_id AS id", "event_type AS quantity_kind", "'pending_llm' AS status")
    return facade.adjudication_batches(rows).select("quantity_kind", "batch", "id")


@query(
    cte(P)
    + """SELECT id, CASE WHEN confidence IS NULL THEN 'Sits in ' || lang WHEN confidence < 0.5 THEN 'Sits between ' || lang || ' and its neighbours' ELSE 'Sits firmly in ' || lang END || CASE WHEN id % 5 = 0 THEN ' · Unlike most of the library' ELSE '' END AS placement,
    id || CASE WHEN year IS NULL THEN '' ELSE ' · ' || year END || ' · ' || source AS caption FROM papers"""
)
def l6_sentences(spark, d):
    drift = F.when(F.col("id") % 5 == 0, 2.0).otherwise(0.5)
    return library(spark, d, P).select("id", review.placement_sentence(F.col("lang"), F.col("confidence"), drift).alias("placement"), review.stop_caption(F.col("id"), F.col("year"), F.col("source")).alias("caption"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR len(string_split(p_name, ' ')) < 2 THEN NULL ELSE 'Both regions study the ' || p_name END AS summary FROM part")
def n5_bridge_summaries(spark, d):
    return table(spark, d, "part").select("p_partkey", review.bridge_summary(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Both  regions study the "), "p_name")).alias("summary"))