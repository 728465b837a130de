"""Vector expressions and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Length one; lengths under 1e-12 count as 1e-12.  The length is an element that the inner lambda is given: it would be summed up again for every number."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(F.array(size), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def mean_columns(dim: int, column: str = "v") -> list[Column]:
    """Element-wise means as plain aggregates: they combine map-side and keep no vectors."""
    return [F.avg(F.col(column)[k].cast("double")).alias(f"_m{k}") for k in range(dim)]


def centroids(vectors: DataFrame, key: str, column: str = "v", dim: int = 64) -> DataFrame:
    """(key, centroid, size): the mean vector of each group."""
    means = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *mean_columns(dim, column))
    return means.select(key, F.array(*[F.col(f"_m{k}") for k in range(dim)]).alias("centroid"), "size")


def unit_centroids(vectors: DataFrame, key: str, column: str = "v", dim: int = 64) -> DataFrame:
    """As centroids, of unit vectors, and of length one themselves."""
    means = centroids(vectors.withColumn(column, unit(F.col(column))), key, column, dim)
    return means.withColumn("centroid", unit(F.col("centroid")))
