"""A corpus pipeline: quality, exact copies, near copies, source weights, tokens.

Each stage takes the documents that its predecessor kept, and all but the last
return documents.  Stages are written to the shared folder in between, so a lost executor costs no
finished stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import BpeModel, token_digests
from lectern.llm.common import materialize, scratch
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.minhash import near_duplicates
from lectern.llm.mixing import mix
from lectern.llm.quality import score_quality, train
from lectern.llm.queries import tokenizer_path

#: Words of a shingle where near copies are told; op7's own contract has four.
NEAR_SHINGLE = 5


def _row_key(docs: DataFrame):
    """Tells rows apart that differ in any column, nulls included, by 256 bits."""
    return F.unhex(F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))


def _with_plain_names(stage):
    """Columns that the stages don't read get names that clash with nothing while they run."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [c if c in ("doc_id", "text", "source") else f"_column_{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run_stage


@_with_plain_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Each row is judged by its own text: null and empty texts are one empty line and judged as such, very long ones
    whole, repeated rows alike.  Null ids and other columns play no part, whatever their names.  Without labels every
    text scores the same, below the threshold.  An empty table gives an empty result.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, payload=docs.columns).where("predicted = 1").select(*docs.columns)


@_with_plain_names
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the largest id.

    Null texts equal the empty text.  Null ids lose against others; of rows that repeat id and text one stays, with its own
    other columns, whatever their names.  Very long texts are compared like others.  An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    kept = exact_dedup(docs, keep="largest", payload=others).where("kept")
    return kept.withColumnRenamed("id", "doc_id").select(*docs.columns)


@_with_plain_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, null ids last.

    Near copies share 0.8 of their shingles of five words; very long texts are compared whole.  Texts without words (null,
    empty) form no groups and stay, repeated or not.  Of rows of one group that tie by id, or repeat each other in all columns, one
    stays.  Other columns play no part, whatever their names.  An empty table gives an empty result.
    """
    found = materialize(near_duplicates(docs, key=_row_key(docs), shingle=NEAR_SHINGLE), "pipeline-near")
    grouped = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    worded = grouped.select(F.col("first.key").alias("_key"), F.lit(True).alias("_worded"))
    keys = worded.unionByName(found.where("n_shingles = 0").select(F.col("key").alias("_key"), F.lit(False).alias("_worded")).distinct())
    kept = docs.withColumn("_key", _row_key(docs)).join(keys.hint("merge"), "_key")
    repeats = found.where("n_shingles > 0").groupBy("key").count().where("count > 1")
    if not repeats.isEmpty():
        kept = kept.where("_worded").dropDuplicates(["_key"]).unionByName(kept.where("NOT _worded"))
    return kept.select(*docs.columns)


@_with_plain_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target weights.

    A document that the mix takes in part, however long, stands once more if it takes half of it at least.  Texts
    without words (null, empty) have no size: they follow the whole epochs of their source alone.  Null sources are one source.  Rows that repeat each other in
    all columns are mixed as one row of all their copies; ids may be null or repeat, ties fall by a hash of the row.  Other
    columns play no part, whatever their names.  An empty table gives an empty result.
    """
    keyed = docs.withColumn("_key", _row_key(docs))
    taken = mix(keyed, id_column="_key")
    copies = (F.col("epochs") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")).cast("int")
    taken = taken.groupBy(F.col("id").alias("_key")).agg(F.sum(copies).alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = materialize(taken, "pipeline-taken")
    if not taken.where("_rows > 1").isEmpty():  # equal rows count together
        keyed = keyed.dropDuplicates(["_key"])
    mixed = keyed.join(taken.where("_copies > 0").hint("merge"), "_key")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and a digest of what they decode to.

    One row per input row, ties and repeats included: null and empty texts have no ids, very long ones are encoded
    whole, null ids stay null.  Other columns are left out, whatever their names.  An empty table gives an empty result.
    """
    tokens = token_digests(docs, BpeModel(tokenizer_path()), with_ids=True)
    return tokens.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", to_tokens),
]

#: A classifier, hashes and a tokenizer are not expressible in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; of a stage that is over only its result stays on disk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
