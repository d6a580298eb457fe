"""Element-wise maps over vectors, particles and cells.

A vector is a DataFrame (idx, v); particles are flat columns; every function adds
or replaces columns without a shuffle, but for adding two vectors that live in
different tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, v): a.v + b.v for the indices that both have; one co-partitioned join."""
    return a.select("idx", F.col("v").alias("x")).join(b.select("idx", F.col("v").alias("y")), "idx").select("idx", (F.col("x") + F.col("y")).alias("v"))


def scale_momenta(particles: DataFrame, factor: float | Column, mass: float | None = None) -> DataFrame:
    """Momenta times a factor; with a mass, the energy follows relativistically."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    out = particles.withColumns({c: F.col(c) * factor for c in ("px", "py", "pz")})
    return out if mass is None else out.withColumn("e", F.sqrt(norm_squared("px", "py", "pz") + F.lit(mass * mass)))


def reset_reference(particles: DataFrame) -> DataFrame:
    """The present position becomes the origin of displacements."""
    now = {f"{c}0": F.col(c) for c in "xyz"} | {f"i{c}": F.lit(0) for c in "xyz"}
    return particles.withColumns(now)


def norm_squared(*columns: str) -> Column:
    total = F.col(columns[0]) * F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c) * F.col(c)
    return total


def inverse_norm(*columns: str, least: float = 1e-6) -> Column:
    """1 / |p|, and 0 where |p| doesn't exceed ``least``."""
    p = F.sqrt(norm_squared(*columns))
    return F.when(p > least, 1 / p).otherwise(F.lit(0.0))


def cell_index(x: str | Column, box: float, cells: int) -> Column:
    """Index along one axis: (x + box/2) / box * cells cut toward zero and kept within 0..cells-1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.least(F.greatest(((x + box / 2) / box * cells).cast("int"), F.lit(0)), F.lit(cells - 1))


def cell_id(box: float, cells: int, x: str = "x", y: str = "y", z: str = "z") -> Column:
    return cell_index(x, box, cells) + cells * cell_index(y, box, cells) + cells * cells * cell_index(z, box, cells)


def normalize_cells(cells: DataFrame, volume: float, least: float = 1e-6) -> DataFrame:
    """Density n = count / volume and velocity u = sum p / sum E of cell sums; u is 0 where there is no energy."""
    flow = {f"u{c}": F.when(F.col("e") > least, F.col(f"p{c}") / F.col("e")).otherwise(0.0) for c in "xyz"}
    return cells.withColumns({"density": F.col("count") / volume} | flow)


def relative_error_pct(a: Column, b: Column) -> Column:
    """100 |a - b| / |b|; 0 where b is 0."""
    return F.coalesce(100 * F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0)), F.lit(0.0))


def relative_change(a: Column, b: Column, least: float = 1e-12) -> Column:
    return (b - a) / F.greatest(F.abs(a), F.lit(least))


def dot(a: list[str], b: list[str]) -> Column:
    total = F.col(a[0]) * F.col(b[0])
    for x, y in zip(a[1:], b[1:]):
        total = total + F.col(x) * F.col(y)
    return total


def cross(a: list[str], b: list[str]) -> tuple[Column, Column, Column]:
    """Components of a x b."""
    part = lambda i, j: F.col(a[i]) * F.col(b[j]) - F.col(a[j]) * F.col(b[i])
    return part(1, 2), part(2, 0), part(0, 1)


def length(*columns: str) -> Column:
    return F.sqrt(norm_squared(*columns))
