"""Pairs of near particles, and what is made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .elementwise import cell_index
from .rounds import written

#: Particles of a block where cells don't part them: pairs of blocks are keys of their own.
PER_BLOCK = 2000
#: Particles of a block whose pairs with another block's are made as arrays, and pairs of a tile of them.
PER_TILE, TILE = 8192, 1 << 18
#: So many bins are counted by comparing with their edges.
FEW_BINS = 32
#: So many particles are compared in pairs of blocks of rows; building arrays would cost more.
FEW = 2500


def minimum_image(d: Column, box: float) -> Column:
    return d - box * F.round(d / box)


def pairs_within(particles: DataFrame, cutoff: float, box: float, periodic: bool = True) -> DataFrame:
    """(a, b, dx, dy, dz, r2) of particles (id, x, y, z) with a < b nearer than the cutoff.

    A range join made an equi-join: cells are no smaller than the cutoff, each
    particle is sent to the neighbouring cells (half of them suffice), and
    distances are tested within cells.  d is the place of a minus that of b.
    Where the cutoff spans (nearly) the whole box, most pairs are results; then
    particles are dealt by id to blocks of about PER_BLOCK, and every pair of blocks
    is a key.
    """
    cells = max(1, int(box / cutoff))
    if periodic and cells < 3:  # neighbours on both sides would be the same cell
        cells = 1
    if cells == 1:
        blocks = 1 + particles.count() // PER_BLOCK
        own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
        left = particles.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}a") for c in "xyz"), own.alias("i"), other.alias("j"))
        right = particles.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}b") for c in "xyz"), own.alias("j"), other.alias("i"))
        return _near(left.join(right, ["i", "j"]), cutoff, box, periodic)
    reach = range(-1, 2) if cells > 1 else range(1)
    offsets = [(i, j, k) for i in reach for j in reach for k in reach]
    cell = [cell_index(c, box, cells).alias(f"c{c}") for c in "xyz"]
    own = particles.select("id", "x", "y", "z", *cell)
    table = F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip("xyz", off))) for off in offsets))
    sent = own.withColumn("o", F.explode(table))
    for c in "xyz":
        at = F.col(f"c{c}") + F.col(f"o.{c}")
        sent = sent.withColumn(f"c{c}", F.pmod(at, F.lit(cells)) if periodic else at)
    right = sent.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}b") for c in "xyz"), "cx", "cy", "cz")
    left = own.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}a") for c in "xyz"), "cx", "cy", "cz")
    return _near(left.join(right, ["cx", "cy", "cz"]), cutoff, box, periodic)


def _near(joined: DataFrame, cutoff: float, box: float, periodic: bool) -> DataFrame:
    joined = joined.where("a < b")
    gaps = {f"d{c}": F.col(f"{c}a") - F.col(f"{c}b") for c in "xyz"}
    if periodic:
        gaps = {k: minimum_image(d, box) for k, d in gaps.items()}
    joined = joined.select("a", "b", *(d.alias(k) for k, d in gaps.items()))
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return joined.withColumn("r2", r2).where(F.col("r2") < cutoff * cutoff)


def _span(low: Column, high: Column, box: float) -> tuple[Column, Column]:
    """Least and largest |d| by minimum image for d between low and high."""
    image = lambda d: F.abs(minimum_image(d, box))
    holds = lambda shift: F.floor(high / box - shift) >= F.ceil(low / box - shift)  # noqa: E731  a multiple of the box, or the middle between two
    return F.when(holds(0.0), 0.0).otherwise(F.least(image(low), image(high))), F.when(holds(0.5), box / 2).otherwise(F.greatest(image(low), image(high)))


def block_pairs(particles: DataFrame, box: float, reach: float, per: int = PER_TILE, ids: bool = False) -> DataFrame:
    """Pairs of blocks (a, b) with the places (xa, ya, za, xb, yb, zb, with ``ids`` also ia and ib) as arrays, dealt over all cores; each pair of particles lies in one.

    Blocks are cells of the periodic box, cut into pieces of about ``per`` particles.
    Pairs of blocks whose bounds are further apart than ``reach`` are left out.
    Whole numbers in a whole box stay whole numbers, moved into the box.
    """
    for c in "xyz":  # null, NaN and infinity are near nothing
        particles = particles.where(F.abs(c) < float("inf"))
    total = particles.count()
    cells = max(1, round((total / per) ** (1 / 3)))
    inside = {c: F.col(c) - box * F.floor(F.col(c) / box) for c in "xyz"}
    kept = {c: inside[c].cast("int") if _whole(particles, box) else F.col(c).cast("double") for c in "xyz"}
    at = F.struct(*(F.least(F.floor(inside[c] / box * cells), F.lit(cells - 1)).cast("int").alias(c) for c in "xyz"))
    rows = particles.select("id", at.alias("cell"), *(v.alias(c) for c, v in kept.items()), *(v.cast("double").alias(f"{c}i") for c, v in inside.items()))
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / per).cast("int").alias("pieces"))  # fewer rows than blocks
    key = F.struct("cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    held = [*(["id"] if ids else []), *"xyz"]
    bounds = [f(f"{c}i").alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, 0), (F.max, 1))]
    blocks = rows.join(pieces, "cell").groupBy(key.alias("block")).agg(F.collect_list(F.struct(*held)).alias("p"), *bounds)  # about ``per`` particles
    blocks = written(blocks.select("block", *(F.col("p")[c].alias(c) for c in held), *(f"{c}{n}" for c in "xyz" for n in (0, 1))))
    side = lambda s: blocks.select(F.col("block").alias(s), *(F.col(f"{c}{n}").alias(f"{s}{c}{n}") for c in "xyz" for n in (0, 1)))
    least = F.lit(0.0)
    for c in "xyz":
        low, _ = _span(F.col(f"a{c}0") - F.col(f"b{c}1"), F.col(f"a{c}1") - F.col(f"b{c}0"), box)
        least = least + low * low
    near = written(side("a").join(side("b"), F.col("a") <= F.col("b")).where(least * (1 - 1e-9) <= reach * reach).select("a", "b"))  # a row a block meets a row a block
    tasks = max(4 * particles.sparkSession.sparkContext.defaultParallelism, -(-near.count() // 256))
    for s in "ab":
        near = near.join(blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c[0]}{s}") for c in held)), s)
    return near.repartition(tasks, "a", "b").withColumn("same", F.col("a") == F.col("b"))


def _whole(particles: DataFrame, box: float) -> bool:
    """Whether squared distances are whole numbers of 31 bits."""
    return float(box).is_integer() and 0.75 * box * box < 2**31 and all(particles.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in "xyz")


def _squares(row, box: float):
    """(first, squared distances of a few places of a against all of b), in tiles that stay in a core's cache; minimum image."""
    import numpy as np

    a, b = ([getattr(row, f"{c}{s}") for c in "xyz"] for s in "ab")
    step = max(1, TILE // max(1, len(b[0])))
    for first in range(0, len(a[0]), step):
        r2 = None
        for p, q in zip(a, b):
            d = np.subtract.outer(p[first : first + step], q)
            if d.dtype.kind == "i":
                np.abs(d, out=d)
                np.minimum(d, int(box) - d, out=d)
            else:
                d -= box * np.round(d / box)
            d *= d
            r2 = d if r2 is None else np.add(r2, d, out=r2)
        yield first, r2


def near_pairs(particles: DataFrame, cutoff: float, box: float, per: int = PER_TILE) -> DataFrame:
    """(a, b, r2) of particles (id, x, y, z) with a < b nearer than the cutoff in a periodic box: all pairs of near blocks as arrays.

    As many rows as there are such pairs, which grows with the square of the
    density; a task holds a pair of blocks and a tile of results.
    """
    import numpy as np
    import pandas as pd

    limit = cutoff * cutoff

    def emit(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                for first, r2 in _squares(row, box):
                    i, j = np.nonzero(r2 < limit)
                    a, b = row.ia[first + i], row.ib[j]
                    keep = a < b if row.same else slice(None)
                    yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "r2": r2[i, j][keep].astype("float64")})

    return block_pairs(particles.select(F.col("id").cast("long").alias("id"), *"xyz"), box, cutoff, per, True).drop("a", "b").mapInPandas(emit, "a long, b long, r2 double")


def squared_distance_counts(places: DataFrame, cutoff: float, box: float, per: int = PER_TILE) -> DataFrame:
    """(r2, n): pairs of particles at whole places of a periodic box by their squared distance, below the cutoff's.

    A task adds up its pairs; what leaves it has at most cutoff * cutoff rows.
    """
    import numpy as np
    import pandas as pd

    if not _whole(places, box):
        raise ValueError("places and box must be whole numbers")
    limit = int(math.ceil(cutoff * cutoff))

    def add(frames):
        n = np.zeros(limit, "int64")
        for frame in frames:
            for row in frame.itertuples(index=False):
                here = np.zeros(limit, "int64")
                for _, r2 in _squares(row, box):
                    here += np.bincount(r2[r2 < limit], minlength=limit)
                if row.same:  # both orders, and each with itself
                    here[0] -= len(row.xa)
                    here //= 2
                n += here
        found = np.nonzero(n)[0]
        yield pd.DataFrame({"r2": found, "n": n[found]})

    parts = block_pairs(places, box, cutoff, per).drop("a", "b").mapInPandas(add, "r2 long, n long")
    return parts.groupBy("r2").agg(F.sum("n").alias("n"))


def distance_counts(particles: DataFrame, box: float, bins: int, width: float, per: int = PER_TILE) -> DataFrame:
    """(bin, n): pairs of particles by distance (minimum image), bins of a width up to bins * width.

    Pairs of blocks are compared as arrays and added up in their task.
    All pairs are compared, as nearly all lie in some bin.
    """
    import numpy as np
    import pandas as pd

    whole = _whole(particles, box)

    def add(frames):
        n = np.zeros(bins, "int64")
        # of whole squares, the first at each bin's lower edge or beyond: the same division as for a pair
        squares = np.arange(int((bins * width) ** 2) + 2 if whole and bins <= FEW_BINS and (bins * width) ** 2 <= 0.75 * box * box + 1 else 0)
        edges = np.searchsorted(np.floor(np.sqrt(squares) / width), np.arange(1, bins + 1)).tolist() if len(squares) else None
        for frame in frames:
            for row in frame.itertuples(index=False):
                here = np.zeros(bins, "int64")
                for _, r2 in _squares(row, box):
                    if edges:
                        here += np.diff([0, *(np.count_nonzero(r2 < e) for e in edges)])
                    else:
                        at = np.floor(np.sqrt(r2.ravel()) / width)
                        here += np.bincount(at[at < bins].astype("int64"), minlength=bins)
                if row.same:  # both orders, and each with itself
                    here[0] -= len(row.xa)
                    here //= 2
                n += here
        yield pd.DataFrame({"bin": np.arange(bins), "n": n})

    parts = block_pairs(particles, box, bins * width, per).drop("a", "b").mapInPandas(add, "bin long, n long")
    return parts.groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")


def radial_distribution(particles: DataFrame, box: float, bins: int, few: int = FEW) -> DataFrame:
    """(bin, r, g) on [0, box/2]: pair counts over those of an even spread of as many particles."""
    width = box / 2 / bins
    if particles.count() <= few:
        pairs = pairs_within(particles, box / 2, box).select(F.floor(F.sqrt("r2") / width).cast("long").alias("bin")).where(F.col("bin") < bins)
        n = pairs.groupBy("bin").agg((2 * F.count("*")).alias("n"))
    else:
        n = distance_counts(particles, box, bins, width).select("bin", (2 * F.col("n")).alias("n"))
    every = particles.sparkSession.range(bins).withColumnRenamed("id", "bin")
    r = (F.col("bin") + 0.5) * width
    shell = F.lit(4 * math.pi * width) * r * r
    total = particles.agg(F.count("*").cast("double").alias("total"))  # one row
    spread = F.col("total") * F.col("total") / F.lit(box**3)
    return every.join(n, "bin", "left").crossJoin(F.broadcast(total)).select("bin", r.alias("r"), (F.coalesce("n", F.lit(0)) / (shell * spread)).alias("g"))


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))


def structure_factor(rdf: DataFrame, rho: float, qs: list[float]) -> DataFrame:
    """(q, s): 1 + 4 pi rho times the integral of r^2 (g - 1) sinc(r / rmax) sinc(q r / pi), by trapezoids."""
    spark = rdf.sparkSession
    q = spark.createDataFrame([(float(x),) for x in qs], "q double")
    top = rdf.agg(F.max("r").alias("rmax"))
    f = F.col("r") * F.col("r") * (F.col("g") - 1) * sinc(F.col("r") / F.col("rmax")) * sinc(F.col("q") * F.col("r") / math.pi)
    rows = rdf.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(q)).withColumn("f", f)  # bins times wave numbers
    w = Window.partitionBy("q").orderBy("r")
    area = 0.5 * (F.col("f") + F.lead("f").over(w)) * (F.lead("r").over(w) - F.col("r"))
    return rows.withColumn("area", area).groupBy("q").agg((1 + 4 * math.pi * rho * F.coalesce(F.sum("area"), F.lit(0.0))).alias("s"))


def first_shell(rdf: DataFrame, rho: float) -> DataFrame:
    """Peak in 0.8..2.0, the minimum after it up to 2.4, and the coordination number up to that minimum."""
    peak = rdf.where(F.col("r").between(0.8, 2.0)).agg(F.max_by(F.struct("r", "g"), F.struct(F.col("g"), -F.col("bin"))).alias("p"))
    after = rdf.crossJoin(F.broadcast(peak)).where((F.col("r") > F.col("p.r")) & (F.col("r") <= 2.4))
    low = after.agg(F.min_by("r", F.struct("g", "bin")).alias("min_r"))
    w = Window.orderBy("r")  # as many rows as bins
    y = 4 * math.pi * rho * F.col("r") * F.col("r") * F.col("g")
    parts = rdf.crossJoin(F.broadcast(low)).where(F.col("r") <= F.col("min_r")).withColumn("y", y)
    parts = parts.withColumn("area", 0.5 * (F.col("y") + F.lead("y").over(w)) * (F.lead("r").over(w) - F.col("r")))
    total = parts.agg(F.sum("area").alias("coordination"))
    return peak.crossJoin(low).crossJoin(total).select(F.col("p.r").alias("peak_r"), F.col("p.g").alias("peak_g"), "min_r", "coordination")


def low_q(sq: DataFrame, points: int = 8) -> DataFrame:
    """Intercept at q = 0 of a line through S against q^2 of the first points."""
    from .aggregates import linear_fit

    first = sq.orderBy("q").limit(points).select((F.col("q") * F.col("q")).alias("q2"), "s")
    return linear_fit(first, "q2", "s").select(F.col("intercept").alias("s0"))


def random_pairs(particles: DataFrame, cell: str, seed: int) -> DataFrame:
    """Disjoint random pairs within each cell: neighbours in the order of a seeded hash."""
    w = Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    ranked = particles.withColumn("rn", F.row_number().over(w)).withColumn("pair", F.floor((F.col("rn") - 1) / 2))
    two = ranked.groupBy(cell, "pair").agg(F.min_by("id", "rn").alias("a"), F.max_by("id", "rn").alias("b"), F.count("*").alias("n"))
    return two.where("n = 2").select(cell, "a", "b")
