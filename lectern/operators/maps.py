"""Layouts: normalising, morphing, alignment, drift, projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{b}{c}") - F.col(f"{a}{c}")) ** 2 for c in AXES), F.lit(0.0)))


def morph_targets(base: DataFrame, target: DataFrame) -> DataFrame:
    """Where each point of ``base`` goes; points that ``target`` lacks stay."""
    b = base.select("id", *[F.col(c).alias(f"b{c}") for c in AXES])
    t = target.select("id", *[F.col(c).alias(f"t{c}") for c in AXES])
    joined = b.join(t, "id", "left")
    return joined.select("id", *[f"b{c}" for c in AXES], *[F.coalesce(f"t{c}", f"b{c}").alias(f"t{c}") for c in AXES])


def morph(base: DataFrame, target: DataFrame, t: float) -> DataFrame:
    m = morph_targets(base, target)
    return m.select("id", *[(F.col(f"b{c}") * (1 - t) + F.col(f"t{c}") * t).alias(c) for c in AXES])


def farthest(base: DataFrame, target: DataFrame, limit: int = 5) -> DataFrame:
    """The points that move farthest between two layouts."""
    return morph_targets(base, target).select("id", _distance("b", "t").alias("distance")).orderBy(F.desc("distance"), "id").limit(limit)


def normalise(points: DataFrame, radius: float = 40.0, share: float = 0.9) -> DataFrame:
    """Centred, and scaled so that the point at ``share`` of the sorted distances lies at ``radius``.

    The centre and the distance of that rank are two small aggregates; points only meet single rows.
    """
    centre = points.agg(*[F.avg(c).alias(f"c{c}") for c in AXES], F.count(F.lit(1)).alias("n"))
    moved = points.crossJoin(F.broadcast(centre)).select("id", "n", *[(F.col(c) - F.col(f"c{c}")).alias(c) for c in AXES])
    away = moved.withColumn("r", F.sqrt(sum((F.col(c) ** 2 for c in AXES), F.lit(0.0))))
    # Exact rank by two steps: counts of a thousand bands of distance, then the rows of one band.
    top = away.agg(F.max("r").alias("top"), F.max("n").alias("n"))
    banded = away.crossJoin(F.broadcast(top.select("top"))).withColumn("band", F.least(F.lit(999), F.floor(F.col("r") / F.greatest("top", F.lit(1e-300)) * 1000)))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    before = F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("band"))  # a thousand rows at most
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    chosen = counts.withColumn("after", before).where((F.col("after") > rank) & (F.col("after") - F.col("m") <= rank)).select("band", (rank - (F.col("after") - F.col("m"))).alias("inner"))
    inside = banded.join(F.broadcast(chosen), "band").withColumn("k", F.row_number().over(Window.partitionBy("band").orderBy("r")) - 1)
    reference = inside.where("k = inner").select(F.col("r").alias("reference"))
    scale = F.when(F.col("reference") > 1e-6, radius / F.col("reference")).otherwise(F.lit(1.0))
    return moved.crossJoin(F.broadcast(reference)).select("id", *[(F.col(c) * scale).alias(c) for c in AXES])


def alignment(candidate: DataFrame, reference: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Procrustes: matrix and shift that turn, mirror, scale and move a layout onto another by the points they share.

    Spark sums the moments of the shared points (means, squares, 3 x 3 products); only those reach the
    driver.  Fewer than two shared points, or no extent, give the identity.
    """
    a, b = candidate.select("id", *AXES), reference.select("id", *[F.col(c).alias(f"r{c}") for c in AXES])
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.avg(c).alias(f"m{c}") for c in AXES] + [F.avg(f"r{c}").alias(f"mr{c}") for c in AXES]
    sums += [F.avg(F.col(c) ** 2).alias(f"q{c}") for c in AXES] + [F.avg(F.col(f"r{c}") ** 2).alias(f"qr{c}") for c in AXES]
    sums += [F.avg(F.col(c) * F.col(f"r{e}")).alias(f"p{c}{e}") for c in AXES for e in AXES]
    s = a.join(b, "id").agg(*sums).first()
    if s["n"] < 2:
        return np.eye(3), np.zeros(3)
    mean_a, mean_b = (np.array([s[f"{p}{c}"] for c in AXES]) for p in ("m", "mr"))
    size_a = np.sqrt(max(0.0, sum(s[f"q{c}"] for c in AXES) - mean_a @ mean_a))
    size_b = np.sqrt(max(0.0, sum(s[f"qr{c}"] for c in AXES) - mean_b @ mean_b))
    if size_a < 1e-12 or size_b < 1e-12:
        return np.eye(3), np.zeros(3)
    cross = np.array([[s[f"p{c}{e}"] for e in AXES] for c in AXES]) - np.outer(mean_a, mean_b)
    u, sigma, vt = np.linalg.svd(cross / (size_a * size_b))
    turn, scale = u @ vt, sigma.sum() * size_b / size_a
    return scale * turn, mean_b - scale * mean_a @ turn


def align(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """The layout, moved onto the other one by ``alignment``."""
    matrix, shift = alignment(candidate, reference)
    moved = [sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(AXES)), F.lit(float(shift[j]))).alias(e) for j, e in enumerate(AXES)]
    return candidate.select("id", *moved)


def node_size(pages: Column) -> Column:
    """Size of a node by its pages; unknown counts as 12."""
    p = F.greatest(F.coalesce(pages, F.lit(12)), F.lit(1))
    return 0.62 + 0.78 * F.least(F.ln(p + 1) / F.ln(F.lit(21.0)), F.lit(1.9))


def provisional_halo(provisional: Column, drift: Column) -> Column:
    return F.when(provisional, 1 + F.least(F.coalesce(drift, F.lit(0.0)), F.lit(3.0)) * 0.35).otherwise(F.lit(1.0))


def fit_pca(vectors: DataFrame, dim: int, axes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading components of ``v``; all sums are made in the JVM."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("v"))
    mean = np.asarray(rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
    chosen = PCA(k=min(axes, dim), inputCol="v", outputCol="p").fit(rows).pc.toArray()
    sign = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return mean, np.pad(chosen * sign, ((0, 0), (0, axes - chosen.shape[1])))


def project(vectors: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """Places vectors by a fitted projection; others keep their places."""
    moved = F.zip_with(F.col("v"), F.lit(mean.tolist()), lambda x, m: x.cast("double") - m)
    axes = [F.aggregate(F.zip_with(F.col("_v"), F.lit(components[:, k].tolist()), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x).alias(c) for k, c in enumerate(AXES)]
    return vectors.withColumn("_v", moved).select("id", *axes)
