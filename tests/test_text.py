"""Texts: pages, sections, chunks, metadata, measures, search."""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed, measures
from lectern.functions import text as tx
from lectern.functions.stem import stem
from lectern.operators import catalog, chunks, metadata, search
from lectern.sources import documents as sources
from lectern.sources.html import html_to_markdown


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_html_blocks():
    html = "<head><title>no</title></head><h1>A  b</h1><p>one<br>two<script>x</script> &amp; three</p><ul><li>item</li></ul><svg><p>no</p></svg>tail"
    assert html_to_markdown(html) == "# A b\n\none\n\ntwo & three\n\n- item\n\ntail"
    assert html_to_markdown("") == ""
    assert html_to_markdown(None) is None


def test_sections_keep_the_preamble(spark):
    text = "before\n# One\nbody 1\n## Two words \n\nbody 2\n# Empty\n"
    found = one(spark, chunks.sections(F.lit(text)))
    assert [(s["title"], s["level"], s["body"]) for s in found] == [(None, 0, "before"), ("One", 1, "body 1"), ("Two words", 2, "body 2"), ("Empty", 1, "")]


def test_chunks_stay_inside_sections(spark):
    long = ". ".join(f"Sentence {k} says something plain" for k in range(200))
    text = f"# First\n{long}\n# References\n{long}\n# Second\n{'b' * 150}\n# Tiny\nno"
    rows = chunks.chunk_markdown(spark.createDataFrame([(1, text), (2, None)], "id long, markdown string"), "id").orderBy("ord").collect()
    assert {r.section for r in rows} == {"First", "Second"}
    assert [r.ord for r in rows] == list(range(len(rows)))
    assert all(120 <= len(r.text) <= 1800 for r in rows)
    firsts = [r.text for r in rows if r.section == "First"]
    assert all(b[:50] in a for a, b in zip(firsts, firsts[1:], strict=False))


def test_chunk_budget_goes_round(spark):
    long = "word " * 2000
    text = "".join(f"# S{k}\n{long}\n" for k in range(4))
    rows = chunks.chunk_markdown(spark.createDataFrame([(1, text)], "id long, markdown string"), "id", most=6).collect()
    assert sorted(r.section for r in rows) == ["S0", "S0", "S1", "S1", "S2", "S3"]


def test_all_chunks_of_a_long_document_are_given(spark, tmp_path):
    from lectern.plans.registry import QUERIES

    text = "".join(f"# S{k}\n{str(k) * 150}\n" for k in range(1300)) + "# Last\n" + "word " * 2000
    spark.createDataFrame([(1, text), (2, "# A\n" + "b" * 130)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["x3_chunks_of_documents"](spark, str(tmp_path)).orderBy("ord").collect()
    last = len(chunks.split_long(("word " * 2000).strip()))
    assert [r.ord for r in rows if r.doc_id == 1] == list(range(1300 + last)) and [r.ord for r in rows if r.doc_id == 2] == [0]
    assert [r.digest for r in rows if r.doc_id == 1][:1300] == [hashlib.md5((str(k) * 150).encode()).hexdigest() for k in range(1300)]


def test_split_long_overlaps_and_ends():
    text = "".join(np.random.default_rng(0).choice(list("abc. \n"), 5000))
    pieces = chunks.split_long(text)
    assert pieces[0] == text[: len(pieces[0])] and text.endswith(pieces[-1])
    assert all(len(p) <= fixed.CHUNK_CHARS for p in pieces)


def test_functions_have_names_in_sql(spark):
    from lectern.plans import sql

    sql.register(spark)
    texts = {1: "word. " * 900, 2: "short", 3: None, 4: "", 5: "para\n\n" * 1000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = spark.sql("SELECT doc_id, p.ord, p.text FROM {docs} AS t, LATERAL split_long(t.text) AS p", docs=docs).collect()
    assert sorted((r.doc_id, r.ord, r.text) for r in found) == [(i, k, x) for i, t in texts.items() if t is not None for k, x in enumerate(chunks.split_long(t))]
    row = spark.sql("SELECT html_markdown('<h1>A</h1>') AS m, title_of('# A title long enough') AS t, synopsis_of('x').text AS s, excerpt_of('x') AS e").first()
    assert (row.m, row.t, row.s, row.e) == ("# A", "A title long enough", None, None)


def test_work_keys(spark):
    key = lambda **k: one(spark, tx.work_key(*[F.lit(k.get(n)).cast("string") for n in ("doi", "arxiv", "title", "author", "digest")]))
    assert key(doi="https://doi.org/10.1000/AbC.1).") == "doi:10.1000/abc.1"
    assert key(arxiv="arXiv:2101.00001v3") == "arxiv:2101.00001"
    assert key(title="The  Title!", author="A. Vaswani") == "title:the-title|vaswani"
    assert key(title="The Title", author="Ashish Vaswani") == "title:the-title|vaswani"
    assert key(digest="ff") == "sha256:ff"
    assert key() is None


def test_authors(spark):
    assert one(spark, tx.split_authors(F.lit("Alan Turing2,3, Ada Lovelace* and Firstname Lastname; B & C. D"))) == ["Alan Turing", "Ada Lovelace", "C. D"]


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("# Meno\n\ntext", "Meno"),
        ("PREPRINT 12\n\n# A **Real** Title of Work\n", "A Real Title of Work"),
        ("# Journal Pre-proof\n## The Title on Level Two\n", "The Title on Level Two"),
        ("On the shape of quiet things\n# **Chiara Pozzi**\nDepartment of Physics\n", "On the shape of quiet things"),
        ("IAC-24-C1.7.1\nOrbital debris and its removal\n", "Orbital debris and its removal"),
        ("# 1 Introduction\nAbstract of nothing much here\nLater line that is long\n", None),
        ("", None),
    ],
)
def test_titles(text, title):
    assert metadata.guess_title(text) == title


PROSE = "This paragraph says something about the subject at hand and goes on for a while so that it is long enough. " * 2 + "It has more than one sentence, as prose does. The end comes here."


def test_synopsis_ladder():
    assert metadata.find_synopsis(f"# T\n\n## Abstract\n\n{PROSE}\n\n# 1 Introduction\n\nx")[1] == "labelled_abstract"
    assert metadata.find_synopsis(f"# T\n\n## Preface\n\n{PROSE}\n")[1] == "preface"
    assert metadata.find_synopsis(f"# T\n\n{PROSE}\n\n# Introduction\n\nx")[1] == "unlabelled_abstract"
    big = "x" * 130_000
    assert metadata.find_synopsis(f"# Introduction\n\n{PROSE}\n\n{big}")[1] == "introduction"
    assert metadata.find_synopsis(f"# Chapter\n\n{PROSE}\n\n{big}")[1] == "topical_digest"
    assert metadata.find_synopsis(None) == (None, None)


def test_prose_agrees_in_both_engines(spark):
    texts = [PROSE, "lower start. " + PROSE, "Figure 1. " + PROSE, "| a | b | c | " + PROSE, "All rights reserved. " + PROSE, "Short. Text.", "A B C D " * 60 + ". . .", ""]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(tx.is_prose(F.col("t")), F.lit(False)).alias("p")).collect()]
    assert got == [metadata.Block(t).prose for t in texts]


SENTENCES = [
    ("The satellite orbits at 705 km above the ground each day.", [("length", 705000.0, "meter")]),
    ("The resting potential was near -70 mV in every cell.", [("voltage", -0.07, "volt")]),
    ("Samples were kept at 35 °C for the whole of the night.", [("temperature", 308.15, "kelvin")]),
    ("Depths of 10-20 km were found along the whole trench.", [("length", 10000.0, "meter")]),
    ("A rate of 3 ± 0.4 Hz was seen in all of the trials.", [("frequency", 3.0, "hertz")]),
    ("About 12 % of them and a level of 23 dB were reported.", [("fraction", 0.12, "dimensionless"), ("level", 23.0, "dB")]),
    ("It moved at 7.8 km/s and held 7.0 mg/l of the salt.", [("velocity", 7800.0, "meter / second"), ("mass_concentration", 0.007, "gram / liter")]),
    ("We gave 10 µM in 50 mL to each of the dishes there.", [("molarity", 1e-5, "molar"), ("volume", 0.05, "liter")]),
    ("It took 12 RJ and then some to get there in the end.", [("unknown", None, None)]),
    ("The oven stood at 37 ° C while we waited for the men.", [("unknown", None, None)]),
    ("At 10:30 UTC there were 120 participants in 2019 there.", []),
    ("We saw -7 A < i and 5 t and 3 D in the long table there.", []),
]


def test_measures(spark):
    rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(SENTENCES)], "k int, t string")
    found = {}
    for r in measures.extract_quantities(rows, "t", ["k"]).collect():
        found.setdefault(r.k, []).append((r.quantity_kind, r.value_si, r.unit_si))
    for k, (sentence, want) in enumerate(SENTENCES):
        got = sorted(found.get(k, []), key=str)
        if sentence.startswith("We saw"):
            got = [g for g in got if g[0] != "unknown"]
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want, key=str)], sentence
        for (_, x, _), (_, y, _) in zip(got, sorted(want, key=str), strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9)


def test_display(spark):
    shown = lambda v, k, u=None: one(spark, measures.display(F.lit(v).cast("double"), F.lit(u).cast("string"), F.lit(k)))
    assert shown(705000, "length") == "705 km"
    assert shown(0.0123, "length") == "1.23 cm"
    assert shown(0.12, "fraction") == "12 %"
    assert shown(None, "length") == "?"
    assert shown(308.15, "temperature") == "308 K"


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "conditional": "condit", "hopping": "hop", "falling": "fall", "happy": "happi", "probate": "probat", "controll": "control", "agreed": "agre", "generalizations": "gener", "oscillators": "oscil", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def test_search_needs_all_terms(spark):
    rows = spark.createDataFrame([(1, 1, None, "deep learning of maps"), (2, 1, "Deep", "learned maps"), (3, 2, None, "maps only")], "chunk_id long, paper_id long, section string, text string")
    index = search.postings(rows)
    assert {r.chunk_id for r in search.search(index, "deep lear*").collect()} == {1, 2}
    assert search.search(index, "absent").count() == 0
    papers = spark.createDataFrame([(1, "One's title")], "id long, title string")
    hits = search.search_fulltext(rows, index, papers, "maps", 5).collect()
    assert {h.paper_id for h in hits} == {1, 2}


def test_docx_and_epub():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", body)
    assert sources.parse("docx", file.getvalue())["markdown"] == "## Head\n\nText\n\na | b"
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:date>1999</dc:date><dc:date>1954-01-01</dc:date></metadata><manifest><item id="1" href="c1.xhtml"/><item id="2" href="c2.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>')
        z.writestr("o/c1.xhtml", "<h1>One</h1>")
        z.writestr("o/c2.xhtml", "<p>Two</p>")
    found = sources.parse("epub", file.getvalue())
    assert (found["markdown"], found["title"], found["authors"], found["year"]) == ("Two\n\n# One", "T", "A", 1954)
    assert sources.parse("docx", b"no zip")["problem"].startswith("BadZipFile")
    assert sources.parse("pdf", b"%PDF-")["problem"]


def test_djvu_layers():
    def chunk(name, data):
        return name + len(data).to_bytes(4, "big") + data + b"\0" * (len(data) & 1)

    text = b"page text"
    page = chunk(b"FORM", b"DJVU" + chunk(b"INFO", b"\0" * 10) + chunk(b"TXTa", len(text).to_bytes(3, "big") + text))
    raw = b"AT&T" + chunk(b"FORM", b"DJVM" + page + page)
    assert sources.read_djvu(raw) == ("page text\n\npage text", 2)


def small_pdf(packed: bool, contents: bytes, unicode_map: bytes | None = None, extra: bytes = b"") -> bytes:
    """A file of two equal pages; with ``packed`` streams are deflated and dictionaries stand in an object stream."""
    import zlib

    def stream(facts, data):
        data = zlib.compress(data) if packed else data
        return b"<<" + facts + (b"/Filter/FlateDecode" if packed else b"") + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"

    font = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[1/fi/eacute/uni2192]>>" + (b"/ToUnicode 7 0 R" if unicode_map else b"") + b">>"
    plain = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 6 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>", 4: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", 6: font, 8: b"<</Title(A \\(short\\) title)/Author<feff00c9>/CreationDate(D:20190102)>>"}
    streams = {5: stream(b"", contents)} | ({7: stream(b"", unicode_map)} if unicode_map else {})
    if packed:
        body, places = b"", []
        for n, x in plain.items():
            places.append(b"%d %d" % (n, len(body)))
            body += x + b" "
        head = b" ".join(places) + b" "
        streams[9] = stream(b"/Type/ObjStm/N %d/First %d" % (len(plain), len(head)), head + body)
        plain = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + x + b"\nendobj\n" for n, x in (plain | streams).items()) + extra + b"trailer<</Root 1 0 R/Info 8 0 R>>\n%%EOF"


PAGE = rb"""BT /F1 20 Tf 72 700 Td (Heading of it) Tj /F1 10 Tf 0 -40 Td [(Some)-300(text) 20 (s of the \1rst)] TJ
0 -12 Td (line, caf\002 \(and\051 the sec-) Tj 12 TL (ond one \003 x) ' 0 -60 Td (A new paragraph) Tj 80 0 Td (on one line) Tj 1 0 0 1 72 300 Tm <426f6479> Tj ET"""


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text_layers(packed):
    found = sources.parse("pdf", small_pdf(packed, PAGE))
    assert found["problem"] is None, found
    page = "# Heading of it\n\nSome texts of the first\nline, café (and) the second one → x\n\nA new paragraph on one line\n\nBody"
    assert found["markdown"] == f"{page}\n\n{page}" and found["pages"] == 2
    assert (found["title"], found["authors"], found["year"]) == ("A (short) title", "É", 2019)
    assert sources.parse("pdf", small_pdf(packed, PAGE), 1)["markdown"] == page


def test_pdf_unicode_maps_and_problems():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar 2 beginbfrange <0002> <0004> <0041> <0005> <0006> [<4e2d> <6587>] endbfrange"
    raw = small_pdf(True, b"BT /F1 10 Tf 10 10 Td <00010002000300040005000600ff> Tj ET", cmap)
    assert sources.parse("pdf", raw, 1)["markdown"] == "fiABC中文\ufffd"
    assert "no text layer" in sources.parse("pdf", small_pdf(False, b"0 0 10 10 re f"))["problem"]
    assert "protected" in sources.parse("pdf", small_pdf(False, PAGE, extra=b"trailer<</Encrypt 3 0 R>>"))["problem"]
    rng = np.random.default_rng(3)
    whole = small_pdf(True, PAGE)
    for _ in range(300):  # damaged files are rows with a problem, or with what is left of their text
        broken = bytearray(whole)
        for k in rng.integers(0, len(broken), 8):
            broken[k] = rng.integers(0, 256)
        found = sources.parse("pdf", bytes(broken[: rng.integers(9, len(broken))]))
        assert (found["problem"] is None) != (found["markdown"] is None)


def mobi(text: bytes, packing: int = 2, drm: int = 0) -> bytes:
    """A book of one record per 4,000 bytes, packed by letters, copies and spaces."""
    def pack(record):
        out, at = b"", 0
        while at < len(record):
            back = record.rfind(record[at : at + 5], max(0, at - 2000), at) if at + 5 <= len(record) else -1
            if back >= 0:
                out += (0x8000 | (at - back) << 3 | 2).to_bytes(2, "big")
                at += 5
            elif record[at] == 32 and at + 1 < len(record) and 64 <= record[at + 1] < 128:
                out += bytes([record[at + 1] | 0x80])
                at += 2
            elif 9 <= record[at] < 128 or record[at] == 0:
                out += record[at : at + 1]
                at += 1
            else:
                out += b"\x01" + record[at : at + 1]
                at += 1
        return out

    import struct

    parts = [text[k : k + 4000] for k in range(0, len(text), 4000)]
    title = "A Bóok".encode()
    head = struct.pack(">HHIHHH", packing, 0, len(text), len(parts), 4096, drm) + b"\0\0" + b"MOBI" + struct.pack(">III", 228, 2, 65001) + b"\0" * 52 + struct.pack(">II", 248, len(title)) + b"\0" * 156
    head = head[:248].ljust(248, b"\0") + title
    records = [head, *[pack(p) if packing == 2 else p for p in parts]]
    at = 78 + 8 * len(records)
    index = b""
    for r in records:
        index += struct.pack(">II", at, 0)
        at += len(r)
    return b"A_Book".ljust(32, b"\0") + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records)) + index + b"".join(records)


@pytest.mark.parametrize("packing", [1, 2])
def test_mobi(packing):
    text = "<html><body><h1>One é</h1><p>" + "Words and words again, and words. " * 400 + "</p></body></html>"
    found = sources.parse("mobi", mobi(text.encode(), packing))
    assert found["problem"] is None and found["title"] == "A Bóok"
    assert found["markdown"] == html_to_markdown(text)
    assert sources.parse("mobi", mobi(text.encode(), packing, 2))["problem"] == "protected by DRM"
    assert "compression" in sources.parse("mobi", mobi(b"x", 17480))["problem"]
    assert sources.parse("mobi", b"BOOK")["problem"]


def test_decoding():
    assert sources.decode_text("é".encode()) == "é"
    assert sources.decode_text(b"\xef\xbb\xbfx") == "x"
    assert sources.decode_text("é".encode("cp1252")) == "é"


def test_top_terms_ties_by_first_seen(spark):
    rows = spark.createDataFrame([(1, 1, "Beta-gamma alpha results 2020"), (1, 2, "alpha beta")], "c int, ord int, title string")
    assert [r.term for r in catalog.top_terms(rows, ["c"]).orderBy("rank").collect()] == ["beta", "alpha", "gamma"]


def test_quantities_of_whole_texts_equal_a_plain_version(spark):
    """Numbers with units inside the given texts' own prose: found where a plain search for number and unit in every sentence finds them."""
    import regex

    from lectern.functions import fixed, measures

    units = ["mm", "kg", "°C", "GHz", "ms", "furlongs", "km", "%%%"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    said = F.format_string(" It took about %d.5 %s across the whole of it. ", F.col("doc_id") % 90, F.get(F.array(*map(F.lit, units)), F.col("doc_id") % len(units)))
    rows = docs.select("doc_id", F.concat(F.substring("text", 1, 300), said, F.substring("text", 301, 1 << 30)).alias("text"))
    found = sorted((r.doc_id, r.value_original, r.unit_original) for r in measures.extract_quantities(rows, "text", ["doc_id"]).collect())
    low, high = fixed.SENTENCE_CHARS
    want = []
    for r in rows.collect():
        for s in regex.split(r"(?<=[.!?])\s+|\n+", r.text):
            s = s if " " not in s else s.strip()
            if " " not in s or not low <= len(s) <= high or any(m in s for m in fixed.NOT_PROSE):
                continue
            for m in regex.finditer(fixed.QUANTITY_PATTERN, s):
                token = m[3]
                shaped = len(token) <= 4 and regex.search(r"[\p{Lu}°µ/%]", token) and token.lower() not in fixed.NOT_UNITS
                if token not in fixed.NEVER_UNITS and (token in fixed.UNITS or shaped):
                    want.append((r.doc_id, (m[1] + (m[2] or "")).strip(), token))
    assert found == sorted(want) and len(found) > 100


def test_an_answer_is_parsed_once(spark):
    """However many fields are read of it, and whatever is asked of them."""
    from lectern.operators import review

    answer = '{"genre": "survey-or-review", "question": "Why  so", "argument": "because", "significance": "much", "claims": ["a b c d"], "entities": [{"name": "Ada", "kind": "Person"}, {"name": "ADA", "kind": "person"}]}'
    rows = spark.createDataFrame([(1, answer), (2, None), (3, "no json")], "id long, answer string").select("id", review.normal_reading(F.col("answer")).alias("r")).select("id", "r.*")
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
    got = {r.id: r for r in rows.collect()}
    assert (got[1].genre, got[1].question, got[1].claims, [e.name for e in got[1].entities], got[1].grounded) == ("survey-or-review", "Why so", ["a b c d"], ["Ada"], True)
    assert all((got[k].genre, got[k].question, got[k].claims, got[k].entities, got[k].grounded) == ("other", "", [], [], False) for k in (2, 3))


def test_hashed_words_cut_ascii_without_the_pattern(monkeypatch):
    """The pattern only sees what has other letters, and words are the same either way."""
    import re
    import zlib

    from lectern.operators import encode

    seen, find = [], re.compile(r"\w+").findall
    monkeypatch.setattr(encode, "WORDS", lambda t: seen.append(t) or find(t))
    texts = ["One two, one TWO_3 drei", "", "zwei-one\x1cone\x00a", "\u00dcn\u00ef c\u00f6d\u00e9_9 \u00d7x\u00b2 one", "\u0130I one"]
    got = encode.hashed_words(8)(texts)
    assert len(seen) == 2
    want = np.zeros((len(texts), 8))
    for k, t in enumerate(texts):
        for w in find(t.lower()):
            h = zlib.crc32(w.encode())
            want[k, h % 8] += 1 if h >> 31 else -1
    assert got.dtype == np.float32 and (got == want).all()
