"""Prefix scans and positional windows over explicitly ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _choose(key: Column, cuts: list[Column], first: int = 0) -> Column:
    """How many of the ascending cuts lie below the key: a decision tree, so a row is compared log2(cuts) times."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key <= cuts[mid], _choose(key, cuts[:mid], first)).otherwise(_choose(key, cuts[mid + 1 :], first + mid + 1))


def _bucket(df: DataFrame, idx: str, buckets: int) -> Column:
    """Bucket of an index by approximate quantiles: order between buckets is order of the index."""
    cuts = df.agg(F.percentile_approx(idx, [i / buckets for i in range(1, buckets)], max(1000, 10 * buckets))).first()[0] or []
    return _choose(F.col(idx), [F.lit(c) for c in sorted(set(cuts))])


#: Rows of the sample for each bucket of several columns.
SAMPLED = 50


def order_buckets(df: DataFrame, order: list[str], buckets: int, total: int | None = None) -> Column:
    """Bucket of a row by all order columns together, cut at rows of a sample: no value, however common, fills a bucket if the columns tell rows apart."""
    share = min(1.0, SAMPLED * buckets / max(1, df.count() if total is None else total))
    rows = df.select(F.struct(*order).alias("o")).sample(share, 1).orderBy("o").collect()  # SAMPLED rows a bucket, whatever the table
    kinds = [df.schema[c].dataType for c in order]
    cuts: list = []
    for i in range(1, buckets):
        at = rows[i * len(rows) // buckets]["o"] if rows else None
        if at is not None and (not cuts or cuts[-1] != at):
            cuts.append(at)
    literal = lambda at: F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(at, kinds, order)))
    return _choose(F.struct(*order), [literal(at) for at in cuts])


def prefix_sum(df: DataFrame, idx: str = "idx", v: str = "v", out: str = "scan", exclusive: bool = False, buckets: int | None = None) -> DataFrame:
    """Running sum of v in the order of idx, in two phases.

    Rows are dealt to ordered buckets; sums of buckets (a row each) are scanned
    first and sent to all tasks; each bucket then scans its own rows.  No task
    sees more than a bucket, where a window over everything would see all.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("__b", _bucket(df, idx, buckets))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("__b").agg(F.sum(v).alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    joined = marked.join(F.broadcast(sums), "__b")  # at most ``buckets`` rows
    return joined.withColumn(out, F.col("__o") + F.coalesce(F.sum(v).over(inside), F.lit(0))).drop("__b", "__o")


def row_numbers(df: DataFrame, idx: str = "idx", out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Position from 0 in the order of idx, in two phases as prefix_sum."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), idx, "__one", out, True, buckets).drop("__one")


def ranks(df: DataFrame, by: list[Column], idx: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Position from 0 in the order of the ascending columns ``by``, then of the distinct idx, in two phases.

    Rows are dealt to ordered buckets of (by, idx); the buckets' counts (a row
    each) are scanned, and each bucket numbers its own rows.
    """
    return several_ranks(df, {out: by}, idx, buckets)


def several_ranks(df: DataFrame, orders: dict[str, list[Column]], idx: str, buckets: int | None = None) -> DataFrame:
    """A column of ``ranks`` for each order; cuts and counts of all orders come from df, so that no order's numbering is made again for the next one's."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, steps = df.count(), []
    for k, (out, by) in enumerate(orders.items()):
        keys = {f"__by{k}_{i}": c for i, c in enumerate(by)}
        keyed = df.withColumns(keys)
        bucket = order_buckets(keyed, [*keys, idx], buckets, total)
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        starts = keyed.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
        steps.append((out, keys, bucket, starts))
    for out, keys, bucket, starts in steps:
        inside = Window.partitionBy("__b").orderBy(*keys, idx)
        joined = df.withColumns(keys).withColumn("__b", bucket).join(F.broadcast(starts), "__b")  # at most ``buckets`` rows
        df = joined.withColumn(out, F.col("__o") + F.row_number().over(inside) - 1).drop(*keys, "__b", "__o")
    return df


def places(df: DataFrame, by: list[str], order: list[str], out: str = "place", buckets: int | None = None) -> DataFrame:
    """Position from 0 within each group of ``by``, in the order of columns that tell its rows apart; a group lies in as many buckets as its share."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("__b", order_buckets(df, [*by, *order], buckets))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*by, "__b").agg(F.count("*").alias("__n")).withColumn("__o", F.sum("__n").over(before)).where("__o is not null")
    return _with_carried(marked, counts, by, ["__o"]).withColumn(
        out, F.coalesce("__o", F.lit(0)) + F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    ).drop("__b", "__o")


def _with_carried(marked: DataFrame, carried: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """marked with what comes from earlier buckets; only a bucket's first group has earlier ones, so there are fewer rows than buckets."""
    other = carried.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate([*by, "__b"])), *columns)
    same = [marked[c].eqNullSafe(other[f"__{i}"]) for i, c in enumerate([*by, "__b"])]
    return marked.join(F.broadcast(other), same, "left").drop(*(f"__{i}" for i in range(len(by) + 1)))


def carry_forward(df: DataFrame, order: list[str], values: dict[str, str | Column], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """New columns with the last value that isn't null, up to and with each row, in two phases.

    ``order`` tells the rows of a group (or of the table) apart.  Each bucket
    carries forward within itself; the last values of the buckets, a row a bucket,
    are carried between them.
    """
    by, buckets = by or [], buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = {f"__v{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(values.values())}
    marked = df.withColumns(made)
    marked = marked.withColumn("__b", order_buckets(df, [*by, *order], buckets))
    lasts = marked.groupBy(*by, "__b").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in made))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*by).orderBy("__b"))
    carried = lasts.select(*by, "__b", first.alias("__k"), *(F.last(v, ignorenulls=True).over(before).alias(f"{v}c") for v in made)).where("__k > 1")
    joined = _with_carried(marked, carried, by, [f"{v}c" for v in made])
    here = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: F.coalesce(F.last(v, ignorenulls=True).over(here), F.col(f"{v}c")) for n, v in zip(values, made)})
    return out.drop("__b", *made, *(f"{v}c" for v in made))


def row_window(df: DataFrame, kind: str, idx: str = "idx") -> DataFrame:
    """Rows of a positional window: all, second_half, last_80_percent or last_fraction:f (one row at least)."""
    if kind == "all":
        return df
    numbered = row_numbers(df, idx, "__rn")
    total = df.agg(F.count("*").alias("__n"))
    n = F.col("__n")
    if kind == "second_half":
        start = F.floor(n / 2)
    elif kind == "last_80_percent":
        start = F.floor(n / 5)
    elif kind.startswith("last_fraction:"):
        start = F.least(F.greatest(F.floor(n * (1 - float(kind.split(":", 1)[1]))), F.lit(0)), F.greatest(n - 1, F.lit(0)))
    else:
        raise ValueError(f"unknown window {kind!r}")
    return numbered.crossJoin(F.broadcast(total)).where(F.col("__rn") >= start).drop("__rn", "__n")


def every_nth(df: DataFrame, step: str, k: int) -> DataFrame:
    """Rows whose step is a multiple of k."""
    return df.where(F.pmod(F.col(step), F.lit(k)) == 0)


def relative_to_first(df: DataFrame, idx: str, v: str, nth: int = 1, by: list[str] | None = None, out: str = "ratio") -> DataFrame:
    """v over its nth value in order, within each group of ``by``; null where there are fewer.

    The nth values are made first, of the first rows only, and meet the rows by
    group, so that no task holds a group.
    """
    if not by:
        first = df.orderBy(idx).limit(nth).agg(F.when(F.count("*") == nth, F.max_by(v, idx)).alias("__f"))
        return df.crossJoin(F.broadcast(first)).withColumn(out, F.col(v) / F.col("__f")).drop("__f")  # one row
    place = Window.partitionBy(*by).orderBy(idx)  # row_number <= n is cut off before the shuffle
    first = df.withColumn("__k", F.row_number().over(place)).where(F.col("__k") <= nth).where(F.col("__k") == nth).select(*by, F.col(v).alias("__f"))
    keys = [df[c].eqNullSafe(first[c]) for c in by]
    return df.join(first, keys, "left").select(df["*"], (df[v] / F.col("__f")).alias(out))


def trapezoid(df: DataFrame, x: str, y: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Integral of y over x by trapezoids, per group, in two phases.

    Each ordered bucket sums its own trapezoids; its first and last points, a row a
    group and bucket, give those between buckets.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = by or []
    rows = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), _bucket(df, x, buckets).alias("__b"))
    inside = Window.partitionBy(*by, "__b").orderBy("__x")
    area = 0.5 * (F.col("__y") + F.lead("__y").over(inside)) * (F.lead("__x").over(inside) - F.col("__x"))
    ends = [f("__y", "__x").alias(n) for f, n in ((F.min_by, "__y0"), (F.max_by, "__y1"))]
    sums = rows.withColumn("__a", area).groupBy(*by, "__b").agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("__a"), F.min("__x").alias("__x0"), F.max("__x").alias("__x1"), *ends)
    after = Window.partitionBy(*by).orderBy("__b")  # a row a bucket
    gap = 0.5 * (F.col("__y1") + F.lead("__y0").over(after)) * (F.lead("__x0").over(after) - F.col("__x1"))
    total = sums.withColumn("__g", F.coalesce(gap, F.lit(0.0))).groupBy(*by).agg(F.sum(F.col("__a") + F.col("__g")).alias("integral"))
    return total.withColumn("integral", F.coalesce("integral", F.lit(0.0)))


def smooth_periodic(bins: DataFrame, size: int, sigma: float = 1.0, idx: str = "bin", v: str = "v") -> DataFrame:
    """Gaussian smoothing of a periodic series of ``size`` bins, the kernel cut at four sigma."""
    import math

    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights)))
    spread = bins.select(F.col(idx), F.col(v), F.explode(kernel).alias("s"))
    moved = spread.select(F.pmod(F.col(idx) + F.col("s.k"), F.lit(size)).alias(idx), (F.col(v) * F.col("s.w")).alias("__t"))
    return moved.groupBy(idx).agg(F.sum("__t").alias("smooth"))
