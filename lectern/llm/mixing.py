"""Mixing sources to target weights, in DataFrame operations alone.

Efraimidis-Spirakis sampling without replacement: a document's key is an
exponential variate divided by its quality weight; in the order of keys a source's
documents are a weighted random permutation.  A source's budget is filled by
whole epochs first; what is left goes to the documents whose running sum of
sizes, in the order of keys, stays within it (the last of them in part).

No source is sorted in one task.  Keys are dealt to buckets that follow their order and are equally wide on a
logarithmic scale, sqrt(rows of the source) to a factor of e.  Keys of any one weight w are exponential, so a
bucket gets at most a share of 1 / (e sqrt(rows)) of its rows whatever w is, and of mixed weights no more:
some sqrt(rows) / e rows.  Sums of whole buckets are prefix-summed per source, and documents only inside their
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of the sources in the order of their names, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its size.
MAX_EPOCHS = 3
#: A document's quality weight is at least this.
LEAST_WEIGHT = 0.05


def size_in_words(text_column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text_column: str = "text") -> Column:
    """The share of bytes that are not ASCII punctuation, digits or controls, squared."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
    share = F.octet_length(F.translate(text, marks, "")) / F.greatest(F.octet_length(text), F.lit(1))
    return F.greatest(share * share, F.lit(LEAST_WEIGHT))


def uniform(column: str, seed: int, *more: Column) -> Column:
    """A number in (0, 1) that depends on the id, the seed and what else is given alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column), *more), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target of each source; input has src_null, src, source_size.

    Shares follow the weights, filled like connected vessels: sources in the order
    of (limit / weight) reach their limits first, and what they leave is shared by
    the others.  One row per source passes through one task: a million sources are some 50 MB there.
    """
    by_name = Window.orderBy("src_null", F.encode("src", "UTF-8"))
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size").cast("double") * max_epochs)
    everything = Window.partitionBy(F.lit(0))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), "src_null", "src")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    # Levels rise while the source at hand still lies above its limit, then fall: the highest is the answer.
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.max("level").over(everything))
    target = F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit")))
    return t.withColumn("target", target).select("src_null", "src", "source_size", "target")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = SOURCE_WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    quality: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, epochs (whole copies), part (words of one more), taken.

    Sizes count words; null text has none and is never taken.  Null sources are
    one source, after all others.  ``quality`` is the sampling weight (positive; null
    or less counts as LEAST_WEIGHT).  Ties of keys fall by id, then size; rows that
    repeat an id are rows like others, null ids too.  Keys depend on id, text and seed, so reruns
    agree, and rows of one id (or none) have keys of their own unless their texts are equal, too.  A very long text is a size like others; the one on the border is taken in part.  Other columns are
    ignored; an empty table gives an empty result.
    """
    quality = quality_weight(text_column) if quality is None else quality
    key = -F.ln(uniform("id", seed, F.col("salt"))) / F.greatest(F.coalesce("q", F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).isNull().alias("src_null"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("src"),
        size_in_words(text_column).alias("size"),
        quality.cast("double").alias("q"),
        F.xxhash64(F.col(text_column)).alias("salt"),
    )
    rows = materialize(rows.withColumn("key", key).drop("q", "salt"), "mix-keys")

    sizes = rows.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs).join(sizes.select("src_null", "src", "n"), ["src_null", "src"])
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    targets = targets.withColumn("epochs", epochs).withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = materialize(targets.withColumn("buckets", F.ceil(F.sqrt("n"))), "mix-targets")

    bucket = F.floor(F.ln(F.greatest("key", F.lit(1e-300))) * F.col("buckets")).cast("long")
    dealt = rows.join(targets, ["src_null", "src"]).withColumn("bucket", bucket)
    group = ["src_null", "src", "bucket"]
    per_bucket = dealt.groupBy(*group).agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*group, F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy(*group).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(materialize(per_bucket, "mix-buckets"), group)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("bucket_before") - F.col("before"))).cast("long")
    return placed.select("id", "size", "source_size", "target", "epochs", part.alias("part"), (F.col("epochs") * F.col("size") + part).alias("taken"))
