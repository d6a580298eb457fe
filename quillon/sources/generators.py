"""Generated inputs: edges, matrices, vectors, particles.  Values follow from a seed and the row, not from partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import hash_normal, hash_uniform


def rmat_edges(spark: SparkSession, scale: int, edge_factor: int, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Power-law edges by recursive quadrants, both directions."""
    rows = spark.range((1 << scale) * edge_factor)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        u = hash_uniform(seed, "id", F.lit(bit))
        down, right = u >= a + b, ((u >= a) & (u < a + b)) | (u >= a + b + c)
        src, dst = src + F.when(down, 1 << bit).otherwise(0), dst + F.when(right, 1 << bit).otherwise(0)
    from ..operators.graph import undirected

    return undirected(rows.select(src.alias("src"), dst.alias("dst")))


def uniform_edges(spark: SparkSession, vertices: int, edges: int, seed: int = 12345) -> DataFrame:
    at = lambda k: F.floor(hash_uniform(seed, "id", F.lit(k)) * vertices)
    from ..operators.graph import undirected

    return undirected(spark.range(edges).select(at(0).alias("src"), at(1).alias("dst")))


def unique_coo(spark: SparkSession, rows: int, cols: int, nnz: int, seed: int = 3) -> DataFrame:
    """``nnz`` random entries, one per place: the first so many different places that are drawn."""
    at = lambda k, n: F.floor(hash_uniform(seed, "id", F.lit(k)) * n)
    wanted, drawn = min(nnz, rows * cols), max(1, nnz)
    while True:
        drawn *= 2
        first = spark.range(drawn).select("id", at(0, rows).alias("r"), at(1, cols).alias("c")).groupBy("r", "c").agg(F.min("id").alias("id"))
        if first.count() >= wanted:
            return first.orderBy("id").limit(wanted).select("r", "c", hash_uniform(seed, "id", F.lit(2)).alias("v"))


def vector(spark: SparkSession, n: int, seed: int = 5, levels: int | None = None) -> DataFrame:
    """(idx, v) in [0, 1), or whole numbers under ``levels``."""
    u = hash_uniform(seed, "id")
    return spark.range(n).select(F.col("id").alias("idx"), (F.floor(u * levels) if levels else u).alias("v"))


def _thermal(seed: int, temperature: tuple[float, float, float], mass: float) -> dict[str, Column]:
    return {f"p{c}": hash_normal(seed, "id", F.lit(c)) * math.sqrt(t * mass) for c, t in zip("xyz", temperature)}


def lattice_particles(spark: SparkSession, n: int, box: float, temperature: float | tuple[float, float, float], mass: float = 1.0, seed: int = 7) -> DataFrame:
    """Particles on a cubic lattice with thermal momenta; three temperatures make it anisotropic."""
    t = temperature if isinstance(temperature, tuple) else (temperature,) * 3
    side = math.ceil(round(n ** (1 / 3), 9))
    gap = box / side
    at = {c: (F.pmod(F.floor(F.col("id") / side**k), F.lit(side)) + 0.5) * gap - box / 2 for k, c in enumerate("xyz")}
    out = spark.range(n).withColumns(at | _thermal(seed, t, mass))
    e = (F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")) / (2 * mass)
    return out.withColumns({"e": e, "alive": F.lit(True)} | {f"i{c}": F.lit(0) for c in "xyz"} | {f"{c}0": F.col(c) for c in "xyz"})


def ellipsoid_particles(spark: SparkSession, n: int, axes: tuple[float, float, float], temperature: float, mass: float, shear: float = 0.0, seed: int = 9) -> DataFrame:
    """Even in an ellipsoid (inverse of the radial distribution, no rejection), thermal, with a flow vy = shear x / half axis."""
    r = F.pow(hash_uniform(seed, "id", F.lit("r")), F.lit(1 / 3))
    z = 2 * hash_uniform(seed, "id", F.lit("c")) - 1
    phi = 2 * math.pi * hash_uniform(seed, "id", F.lit("p"))
    flat = r * F.sqrt(1 - z * z)
    at = {"x": flat * F.cos(phi) * axes[0], "y": flat * F.sin(phi) * axes[1], "z": r * z * axes[2]}
    out = spark.range(n).withColumns(at | _thermal(seed, (temperature,) * 3, mass))
    out = out.withColumn("py", F.col("py") + mass * shear * F.col("x") / axes[0])
    return out.withColumn("e", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2 + mass * mass)).withColumn("alive", F.lit(True))


def isotropic_particles(spark: SparkSession, n: int, box: float, momentum: float, seed: int = 11) -> DataFrame:
    """Even in the box, momenta of one size and any direction."""
    z = 2 * hash_uniform(seed, "id", F.lit("c")) - 1
    phi = 2 * math.pi * hash_uniform(seed, "id", F.lit("p"))
    flat = F.sqrt(1 - z * z) * momentum
    at = {c: (hash_uniform(seed, "id", F.lit(c)) - 0.5) * box for c in "xyz"}
    p = {"px": flat * F.cos(phi), "py": flat * F.sin(phi), "pz": z * momentum}
    return spark.range(n).withColumns(at | p).withColumns({"e": F.lit(float(momentum)), "alive": F.lit(True)})
