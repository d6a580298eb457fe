"""Neighbourhood operators on grids: each cell's value goes to the cells that need it, where it is weighted and added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(cells: DataFrame, axes: tuple[str, ...], v: str, weights: dict[tuple[int, ...], float], wrap: int | None = None) -> DataFrame:
    """Sum over offsets of weight * value at (cell + offset).

    A cell's value is sent to cell - offset for each offset; with ``wrap`` all
    axes are periodic of that size.
    """
    table = F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip(axes, off)), F.lit(float(w)).alias("w")) for off, w in weights.items()))
    rows = cells.select(*axes, v, F.explode(table).alias("__o"))

    def to(a: str) -> Column:
        at = F.col(a) - F.col(f"__o.{a}")
        return F.pmod(at, F.lit(wrap)) if wrap else at

    return rows.select(*(to(a).alias(a) for a in axes), (F.col(v) * F.col("__o.w")).alias("__t")).groupBy(*axes).agg(F.sum("__t").alias(v))


def convolve2d(image: DataFrame, mask: list[list[float]], height: int, width: int) -> DataFrame:
    """Correlation of (r, c, v) with an odd-sized mask; outside the image is zero; every pixel of the image is in the result."""
    m = len(mask) // 2
    weights = {(i - m, j - m): w for i, row in enumerate(mask) for j, w in enumerate(row)}
    out = spread(image, ("r", "c"), "v", weights)
    return out.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def star(axes: int, centre: float, side: float) -> dict[tuple[int, ...], float]:
    """Weights of a cell and its direct neighbours."""
    out = {(0,) * axes: centre}
    for a in range(axes):
        for d in (-1, 1):
            out[tuple(d if k == a else 0 for k in range(axes))] = side
    return out


def stencil3d(grid: DataFrame, n: int, centre: float = 1.0, side: float = 0.125) -> DataFrame:
    """Seven-point stencil on the inner cells of (i, j, k, v) of size n; the border is not in the result."""
    out = spread(grid, ("i", "j", "k"), "v", star(3, centre, side))
    inner = F.lit(True)
    for a in "ijk":
        inner = inner & F.col(a).between(1, n - 2)
    return out.where(inner)


def smooth3d(grid: DataFrame, n: int, rounds: int = 3, centre: float = 0.4, side: float = 0.1) -> DataFrame:
    """Periodic smoothing, applied again and again."""
    for _ in range(rounds):
        grid = spread(grid, ("i", "j", "k"), "v", star(3, centre, side), wrap=n)
    return grid


def neighbours(grid: DataFrame, n: int, values: list[str]) -> DataFrame:
    """Each cell with the values of its six periodic neighbours: columns v_im, v_ip, v_jm ... for every v, by one shuffle."""
    offsets = [("", (0, 0, 0))] + [(f"_{a}{s}", tuple(d if k == i else 0 for k in range(3))) for i, a in enumerate("ijk") for s, d in (("m", -1), ("p", 1))]
    table = F.array(*(F.struct(F.lit(name).alias("name"), *(F.lit(o).alias(a) for a, o in zip("ijk", off))) for name, off in offsets))
    rows = grid.select("i", "j", "k", *values, F.explode(table).alias("o"))
    rows = rows.select(*(F.pmod(F.col(a) - F.col(f"o.{a}"), F.lit(n)).alias(a) for a in "ijk"), *values, F.col("o.name").alias("name"))
    return rows.groupBy("i", "j", "k").agg(*(F.max(F.when(F.col("name") == name, F.col(v))).alias(f"{v}{name}") for v in values for name, _ in offsets))


def central(v: str, axis: str, h: float) -> Column:
    return (F.col(f"{v}_{axis}p") - F.col(f"{v}_{axis}m")) / (2 * h)


def laplacian(v: str, h: float) -> Column:
    total = -6 * F.col(v)
    for a in "ijk":
        total = total + F.col(f"{v}_{a}p") + F.col(f"{v}_{a}m")
    return total / (h * h)


def gradient_laplacian(grid: DataFrame, n: int, h: float, v: str = "v") -> DataFrame:
    """(i, j, k, gx, gy, gz, lap) by periodic central differences."""
    near = neighbours(grid, n, [v])
    return near.select("i", "j", "k", *(central(v, a, h).alias(f"g{x}") for a, x in zip("ijk", "xyz")), laplacian(v, h).alias("lap"))


def second_level(grid: DataFrame, n: int, h: float) -> DataFrame:
    """From (lap, ux, uy, uz): gradient of the Laplacian, vorticity, and the six components of the symmetric shear."""
    near = neighbours(grid, n, ["lap", "ux", "uy", "uz"])
    d = {(u, x): central(f"u{u}", a, h) for u in "xyz" for a, x in zip("ijk", "xyz")}
    shear = {f"s{u}{x}": 0.5 * (d[u, x] + d[x, u]) for u, x in ("xx", "xy", "xz", "yy", "yz", "zz")}
    curl = {"wx": d["z", "y"] - d["y", "z"], "wy": d["x", "z"] - d["z", "x"], "wz": d["y", "x"] - d["x", "y"]}
    third = {f"gl{x}": central("lap", a, h) for a, x in zip("ijk", "xyz")}
    return near.select("i", "j", "k", *(c.alias(name) for name, c in (third | curl | shear).items()))
