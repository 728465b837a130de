"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partitions import spread
from .alignment import PieceModel, align_tokenizers
from .bpe import BpeModel, token_digests
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .media import text_images
from .merkle import merkle_manifest
from .minhash import near_duplicates
from .mixing import mix
from .ngram_join import jaccard_join
from .pii import find_pii, train_spans
from .quality import held_out, score_quality, train
from .substring_dedup import substring_dedup
from .token_counts import document_token_counts

#: The end-of-document identifier of the byte-level vocabulary.
SEPARATOR = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = substring_dedup(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "longest_repeat")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_digests(_table(spark, sf_dir, "documents"), BpeModel(tokenizer_path()))
    return rows.withColumnRenamed("id", "doc_id")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(_table(spark, sf_dir, "documents"), with_media=False).withColumnRenamed("id", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return find_pii(docs, train_spans(docs)).withColumnRenamed("id", "doc_id")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).withColumnRenamed("id", "doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_token_counts(_table(spark, sf_dir, "documents"), BpeModel(tokenizer_path()), SEPARATOR)
    return rows.withColumnRenamed("id", "doc_id")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = align_tokenizers(_table(spark, sf_dir, "documents"), BpeModel(tokenizer_path()), PieceModel(tokenizer_path("piece_bpe_32k.model")))
    return rows.withColumnRenamed("id", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_media_columns, op4_license_scan, op5_mix_sources, op6_pii, op7_minhash_dedup, op8_quality_classifier, op9_exact_dedup, op10_token_counts, op11_tokenizer_alignment, op12_merkle_manifest, op13_ngram_join)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _linked_sql(size: int, more: str = "") -> str:
    """Sets of ``size``-word shingles of lower-cased texts, linked from 0.8; components over all pairs."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(list_slice(ws, i, i + {size - 1}), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id{more}
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


#: CRC-32 of an id's digits: the reflected polynomial, a bit at a time.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
#: Every 16 consecutive nodes of a list become the hash of them.
_PARENTS = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(list_slice(nodes, 16 * i + 1, 16 * i + 16), '')))"


def _fields(text: str) -> str:
    """All columns, each with its length in bytes before it."""
    return " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))


ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM t)),
        f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, s + j AS p FROM g JOIN f USING (k), range(13) r(j) WHERE doc_id > least),
        w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM t),
        l(n, doc_id, s, h) AS (SELECT n, doc_id, s, h FROM (SELECT 13 AS n, doc_id, s, md5(k) AS h, min(doc_id) OVER (PARTITION BY k) < max(doc_id) OVER (PARTITION BY k) AS again FROM g) WHERE again
            UNION ALL SELECT n, doc_id, s, h FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) < max(doc_id) OVER (PARTITION BY h) AS again
                FROM (SELECT 2 * a.n AS n, a.doc_id, a.s, md5(a.h || b.h) AS h FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.s = a.s + a.n)) WHERE again),
        m AS (SELECT doc_id, max(n) AS longest FROM l GROUP BY 1),
        q AS (SELECT w.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (c.p IS NULL) AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY 1)
        SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0) AS longest_repeat FROM t LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op7_minhash_dedup": _linked_sql(4, ", coalesce(least, d.doc_id) = d.doc_id AS kept"),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE tampered AS (SELECT *, CASE WHEN {_CRC32} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other FROM documents),
        leaves AS (SELECT doc_id, source, sha256({_fields("text")}) AS leaf, sha256({_fields("other")}) AS changed FROM tampered),
        first AS (SELECT coalesce('=' || source, '') AS tree, list(leaf ORDER BY doc_id, leaf) AS nodes FROM leaves GROUP BY 1),
        below(tree, level, nodes) AS (SELECT tree, 0, nodes FROM first UNION ALL SELECT tree, level + 1, {_PARENTS} FROM below WHERE len(nodes) > 1),
        tops AS (SELECT tree, nodes[1] AS subroot FROM below WHERE len(nodes) = 1),
        above(level, nodes) AS (SELECT 0, list(subroot ORDER BY encode(tree)) FROM tops UNION ALL SELECT level + 1, {_PARENTS} FROM above WHERE len(nodes) > 1),
        levels AS (SELECT t.tree, s.part, s.level, s.nodes FROM tops t JOIN (SELECT tree, 0 AS part, level, nodes FROM below WHERE len(nodes) > 1 UNION ALL SELECT NULL, 1, level, nodes FROM above WHERE len(nodes) > 1) s ON s.tree IS NULL OR s.tree = t.tree),
        placed AS (SELECT doc_id, leaf, changed, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS p0 FROM leaves),
        ranked AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS p1 FROM tops),
        steps AS (SELECT doc_id, leaf, changed, tree, part, level, (CASE part WHEN 0 THEN p0 ELSE p1 END) // (16 ** level)::BIGINT AS p, nodes, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY part, level) AS k FROM placed JOIN ranked USING (tree) LEFT JOIN levels USING (tree)),
        sides AS (SELECT doc_id, leaf, changed, tree, k, coalesce(array_to_string(list_slice(nodes, p // 16 * 16 + 1, p), ''), '') AS l, coalesce(array_to_string(list_slice(nodes, p + 2, p // 16 * 16 + 16), ''), '') AS r, nodes IS NULL AS bare FROM steps),
        proofs AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, count(*) AS n FROM sides GROUP BY 1, 2),
        folded(doc_id, leaf, k, h) AS (SELECT doc_id, leaf, 0, changed FROM placed UNION ALL SELECT f.doc_id, f.leaf, f.k + 1, CASE WHEN bare THEN h ELSE sha256(l || h || r) END FROM folded f JOIN sides s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.k = f.k + 1)
        SELECT p.doc_id, p.leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified
        FROM placed p JOIN tops USING (tree) JOIN (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1) ON true JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf JOIN folded f ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.k = q.n""",
    "op13_ngram_join": _linked_sql(5),
}
