"""Reductions, histograms, moments and fits; partial aggregation is Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import finite


def histogram(values: DataFrame, bins: int = 256, first: int = 0, v: str = "v") -> DataFrame:
    """(bin, n) of integer values, empty bins included."""
    counts = values.groupBy(F.col(v).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(first, first + bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0 of equal widths; the last one holds its right edge; null outside."""
    return F.when((v >= low) & (v < high), F.floor((v - low) / ((high - low) / bins)).cast("long")).when(v == high, F.lit(bins - 1).cast("long"))


def density_histogram(values: DataFrame, low: float, high: float, bins: int, v: str = "v") -> DataFrame:
    """(bin, n, density): counts of equal-width bins, and over (total of the bins times width)."""
    counts = values.select(equal_width_bin(F.col(v), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin")
    dense = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # as many rows as bins
    return dense.withColumn("density", F.col("n") / (total * F.lit((high - low) / bins)))


def sample_std(v: str | Column) -> Column:
    """Sample deviation; 0 for fewer than two values."""
    return F.when(F.count(v) < 2, F.lit(0.0)).otherwise(F.stddev_samp(v))


def last_value(v: str, order: str) -> Column:
    return F.max_by(v, order)


def relative_drift_max(df: DataFrame, v: str, order: str) -> DataFrame:
    """Largest |v - v0| / max(|v0|, 1e-12), v0 the first value in order."""
    first = df.agg(F.min_by(v, order).alias("__v0"))
    drift = F.abs((F.col(v) - F.col("__v0")) / F.greatest(F.abs("__v0"), F.lit(1e-12)))
    return df.crossJoin(F.broadcast(first)).agg(F.max(drift).alias("drift"))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2, n of least squares over rows where both are finite.

    All NaN for fewer than two rows or a constant x; r2 is 1 for a constant y.
    """
    rows = df.where(finite(x) & finite(y)).groupBy(*(by or []))
    n, sxx, syy = F.count("*"), F.var_pop(x), F.var_pop(y)
    nan, bad = F.lit(float("nan")), (n < 2) | (F.coalesce(sxx, F.lit(0.0)) == 0)
    return rows.agg(
        n.alias("n"), F.when(bad, nan).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(bad, nan).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(bad, nan).when(syy == 0, 1.0).otherwise(F.regr_r2(y, x)).alias("r2"),
    )


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, c of y = a x^2 + b x + c by normal equations of power sums: one aggregation, a closed solution."""
    c = {f"s{k}": F.sum(F.pow(F.col(x), F.lit(k))) for k in range(5)} | {f"t{k}": F.sum(F.pow(F.col(x), F.lit(k)) * F.col(y)) for k in range(3)}
    sums = df.agg(*(v.alias(k) for k, v in c.items()))

    def det(m: list[list[str]]) -> Column:
        (a, b, c_), (d, e, f), (g, h, i) = [[F.col(k) for k in row] for row in m]
        return a * (e * i - f * h) - b * (d * i - f * g) + c_ * (d * h - e * g)

    whole = det([["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]])
    first = det([["t2", "s3", "s2"], ["t1", "s2", "s1"], ["t0", "s1", "s0"]])
    second = det([["s4", "t2", "s2"], ["s3", "t1", "s1"], ["s2", "t0", "s0"]])
    third = det([["s4", "s3", "t2"], ["s3", "s2", "t1"], ["s2", "s1", "t0"]])
    return sums.select((first / whole).alias("a"), (second / whole).alias("b"), (third / whole).alias("c"))


def compressibility(df: DataFrame, rho: str, p: str, at: float) -> DataFrame:
    """1 / (rho dP/drho) at a density, from the quadratic fit of P."""
    fit = quadratic_fit(df, rho, p)
    return fit.select((1 / (F.lit(at) * (2 * F.col("a") * at + F.col("b")))).alias("kappa"))


def scaling_metrics(df: DataFrame, family: str, a: str, b: str) -> DataFrame:
    """Per family: RMSE of a against b, span, largest and mean of a / b."""
    ratio = F.col(a) / F.col(b)
    return df.groupBy(family).agg(
        F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias("rmse"), (F.max(ratio) - F.min(ratio)).alias("span"), F.max(ratio).alias("max_ratio"),
        F.avg(ratio).alias("mean_ratio"),
    )


def quarters_check(df: DataFrame, order: str, columns: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Third against fourth quarter of an ordered series: relative difference of means of each column in per cent, WARN beyond its limit."""
    from .scans import row_numbers

    numbered = row_numbers(df, order, "__rn", buckets).crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    third = (F.col("__rn") >= F.floor(F.col("__n") / 2)) & (F.col("__rn") < F.floor(3 * F.col("__n") / 4))
    fourth = F.col("__rn") >= F.floor(3 * F.col("__n") / 4)
    means = numbered.agg(*(F.avg(F.when(q, F.col(c))).alias(f"{c}_{name}") for c in columns for name, q in (("q3", third), ("q4", fourth))))
    diff = {c: 100 * F.abs(F.col(f"{c}_q4") - F.col(f"{c}_q3")) / F.greatest(F.abs(F.col(f"{c}_q3")), F.lit(1e-12)) for c in columns}
    bad = F.lit(False)
    for c, limit in columns.items():
        bad = bad | (diff[c] > limit)
    return means.select(*(d.alias(f"{c}_diff") for c, d in diff.items()), F.when(bad, "WARN").otherwise("OK").alias("status"))


def elliptic_flow(px: str = "px", py: str = "py") -> Column:
    a, b = F.col(px) * F.col(px), F.col(py) * F.col(py)
    return F.avg((a - b) / (a + b))


def azimuth_profile(df: DataFrame, value: str, px: str = "px", py: str = "py", bins: int = 19, least: int = 10) -> DataFrame:
    """Mean of a value over equal bins of the momentum's angle; 0 for bins of at most ``least`` rows; angle pi itself is in none."""
    import math

    bin_ = F.floor((F.atan2(py, px) + math.pi) / (2 * math.pi / bins)).cast("long")
    means = df.withColumn("bin", bin_).where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(means, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > least, F.col("m")).otherwise(0.0).alias("mean"))


def cell_sums(particles: DataFrame, cell: Column | str = "cell") -> DataFrame:
    """count, momentum and energy of each cell."""
    key = particles.withColumn("cell", cell) if isinstance(cell, Column) else particles
    return key.groupBy("cell").agg(F.count("*").alias("count"), *(F.sum(c).alias(c) for c in ("px", "py", "pz", "e")))


def occupancy_check(particles: DataFrame, cell: Column, capacity: int) -> DataFrame:
    """Largest cell and number of particles beyond a capacity."""
    counts = particles.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("largest"), F.coalesce(F.sum(F.greatest(F.col("n") - capacity, F.lit(0))), F.lit(0)).alias("overflow"))


def mean_squared_displacement(box: float) -> Column:
    """Mean |x + image * box - x0|^2."""
    total = None
    for c in "xyz":
        d = F.col(c) + F.col(f"i{c}") * F.lit(box) - F.col(f"{c}0")
        total = d * d if total is None else total + d * d
    return F.avg(total)


def thermo_summary(df: DataFrame, particles: int, rho: float, window: str = "second_half", per_particle: bool = False, idx: str = "step") -> DataFrame:
    """Means over the steady window of a run: temperature, pressure, compressibility factor P / (rho T), and energies a particle.

    df holds idx, t, p, pe and total; energies of the whole system unless ``per_particle``.
    """
    from .scans import row_window

    scale = F.lit(1.0 if per_particle else float(particles))
    mean = row_window(df, window, idx).agg(*(F.avg(c).alias(c) for c in ("t", "p", "pe", "total")))
    return mean.select(
        F.col("t").alias("t_mean"), F.col("p").alias("p_mean"), (F.col("p") / (rho * F.col("t"))).alias("z_mean"), (F.col("pe") / scale).alias("pe_per_particle"),
        (F.col("total") / scale).alias("total_per_particle"),
    )


def relativistic_sums(p2: str, e: str) -> dict[str, Column]:
    """Sums of p^2 / E and of E, and the temperature sum(p^2 / E) / 3n, in one pass."""
    ratio = F.sum(F.col(p2) / F.col(e))
    return {"p2_over_e": ratio, "e": F.sum(e), "temperature": ratio / (3 * F.count("*"))}
