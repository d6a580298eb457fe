"""Sparse and dense matrix products.  A matrix is (r, c, v); a vector is (i, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import written
from .scans import places, ranks

#: Pairs of blocks that a task of matmul_blocks multiplies.
BLOCKS_A_TASK = 512


def spmv(a: DataFrame, x: DataFrame, rows: int | None = None) -> DataFrame:
    """(r, y) of A x.  With ``rows``, rows without entries are there with 0."""
    y = a.join(x.withColumnRenamed("i", "c"), "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    if rows is None:
        return y
    every = a.sparkSession.range(rows).select(F.col("id").alias("r"))
    return every.join(y, "r", "left").select("r", F.coalesce("y", F.lit(0)).alias("y"))


def coo_to_csr(a: DataFrame, rows: int) -> DataFrame:
    """(r, start, entries): entries of a row ordered by column, start: entries of all rows before."""
    from .scans import prefix_sum

    lists = a.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("entries"), F.count("*").alias("nnz"))
    every = a.sparkSession.range(rows).select(F.col("id").alias("r"))
    dense = every.join(lists, "r", "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    return prefix_sum(dense, "r", "nnz", "start", exclusive=True)


def csr_to_ell(csr: DataFrame) -> DataFrame:
    """Every row's entries filled up to the longest with column 0 and value 0."""
    width = csr.agg(F.max("nnz").alias("width"))
    kind = csr.schema["entries"].dataType.simpleString()
    none = F.expr(f"cast(named_struct('c', 0, 'v', 0) as {kind[6:-1]})")
    full = F.concat(F.coalesce("entries", F.array().cast(kind)), F.array_repeat(none, (F.col("width") - F.col("nnz")).cast("int")))
    return csr.crossJoin(F.broadcast(width)).select("r", "nnz", full.alias("entries"))


def ell_to_jds(ell: DataFrame) -> DataFrame:
    """(place, r, nnz): rows by falling number of entries (ties: the smaller row first)."""
    return ranks(ell.select("r", "nnz"), [-F.col("nnz")], "r", "place").select(F.col("place").cast("long").alias("place"), "r", "nnz")


def spmv_csr(csr: DataFrame, x: DataFrame) -> DataFrame:
    """Product from the row form: entries are unfolded, multiplied and added per row."""
    flat = csr.select("r", F.explode("entries").alias("e")).select("r", "e.c", "e.v")
    y = flat.join(x.withColumnRenamed("i", "c"), "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return csr.select("r").join(y, "r", "left").select("r", F.coalesce("y", F.lit(0)).alias("y"))


def spmv_ell(ell: DataFrame, x: DataFrame) -> DataFrame:
    """Product from the padded form: what fills a row up, behind its ``nnz`` entries, is passed over."""
    flat = ell.select("r", "nnz", F.posexplode("entries").alias("k", "e")).where("k < nnz").select("r", "e.c", "e.v")
    y = flat.join(x.withColumnRenamed("i", "c"), "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return ell.select("r").join(y, "r", "left").select("r", F.coalesce("y", F.lit(0)).alias("y"))


def hybrid_width(a: DataFrame, rows: int) -> int:
    """Padded width with the least storage: one more place costs 8 bytes a row and saves 12 for each row with an entry there."""
    lengths = a.groupBy("r").agg(F.count("*").alias("nnz")).groupBy("nnz").agg(F.count("*").alias("n"))
    # the place k pays while more than two thirds of the rows have k entries; (length, rows of that length or more) falls with the length
    at_least = F.sum("n").over(Window.orderBy(F.desc("nnz")).rowsBetween(Window.unboundedPreceding, 0))  # as many rows as different lengths
    best = lengths.select("nnz", at_least.alias("m")).where(12 * F.col("m") > 8 * rows).agg(F.max("nnz")).first()[0]
    return int(best or 0)


def hybrid(a: DataFrame, rows: int, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(padded, list) of a matrix: up to ``width`` entries of each row by column, filled up with column 0 and value 0, and the entries beyond.

    A long row adds to the list and sets no other row's width.  No task holds a row:
    its entries are numbered across buckets.
    """
    a = written(a.select("r", "c", "v"))  # counted, sampled and placed
    width = hybrid_width(a, rows) if width is None else width
    placed = written(places(a, ["r"], ["c"]))  # both parts are made of it
    kind = f"array<struct<c:{a.schema['c'].dataType.simpleString()},v:{a.schema['v'].dataType.simpleString()}>>"
    lists = placed.where(F.col("place") < width).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("entries"))  # at most ``width``
    every = a.sparkSession.range(rows).select(F.col("id").alias("r")).join(lists, "r", "left")
    held = F.coalesce("entries", F.array().cast(kind)).cast(kind)
    none = F.expr(f"cast(named_struct('c', 0, 'v', 0) as {kind[6:-1]})")
    padded = every.select("r", F.size(held).alias("nnz"), F.concat(held, F.array_repeat(none, F.lit(width) - F.size(held))).alias("entries"))
    return padded, placed.where(F.col("place") >= width).select("r", "c", "v")


def spmv_hybrid(padded: DataFrame, rest: DataFrame, x: DataFrame) -> DataFrame:
    """(r, y): products of both parts meet in one sum."""
    flat = padded.select("r", "nnz", F.posexplode("entries").alias("k", "e")).where("k < nnz").select("r", "e.c", "e.v")
    y = flat.unionByName(rest).join(x.withColumnRenamed("i", "c"), "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return padded.select("r").join(y, "r", "left").select("r", F.coalesce("y", F.lit(0)).alias("y"))


def hybrid_bytes(padded: DataFrame, rest: DataFrame) -> DataFrame:
    """hybrid_bytes: of both parts with 4-byte numbers."""
    sizes = padded.agg(F.sum(F.size("entries") * 8 + 4).alias("p")).crossJoin(rest.agg((F.count("*") * 12).alias("l")))  # one row each
    return sizes.select((F.col("p") + F.col("l")).alias("hybrid_bytes"))


def jds_diagonals(ell: DataFrame) -> DataFrame:
    """(k, place, c, v): the jagged diagonals, i.e. the k-th entries of all rows that have as many, rows by falling length."""
    order = ell_to_jds(ell).select("place", F.col("r").alias("row"))
    flat = ell.select("r", "nnz", F.posexplode("entries").alias("k", "e")).where("k < nnz")
    return flat.join(order, flat["r"] == order["row"]).select("k", "place", "e.c", "e.v")


def spmv_jds(diagonals: DataFrame, order: DataFrame, x: DataFrame) -> DataFrame:
    """Product from the jagged diagonals; ``order`` (place, r) leads back to rows."""
    y = diagonals.join(x.withColumnRenamed("i", "c"), "c").groupBy("place").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return order.join(y, "place", "left").select("r", F.coalesce("y", F.lit(0)).alias("y"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, c, v) of A B by a join on the inner index."""
    pairs = a.select("r", F.col("c").alias("k"), F.col("v").alias("x")).join(b.select(F.col("r").alias("k"), "c", F.col("v").alias("y")), "k")
    return pairs.groupBy("r", "c").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matmul_blocks(a: DataFrame, b: DataFrame, block: int = 64) -> DataFrame:
    """(r, c, v) of A B by square blocks: each pair of blocks is multiplied as arrays, so the shuffle carries blocks, not entries.

    Rows of the result that come from no entry are absent, as in the plain form.
    """
    import numpy as np
    import pandas as pd

    def pack(m: DataFrame, row: str, col: str, name: str) -> DataFrame:
        at = (F.col("r") % block * block + F.col("c") % block).cast("int")
        key = m.select(F.floor(F.col("r") / block).alias(row), F.floor(F.col("c") / block).alias(col), at.alias("at"), F.col("v").cast("double").alias("v"))
        rows = key.groupBy(row, col, "at").agg(F.sum("v").alias("v")).groupBy(row, col).agg(F.collect_list(F.struct("at", "v")).alias("e"))  # at most block * block entries
        return rows.select(row, col, F.col("e.at").alias(f"{name}_at"), F.col("e.v").alias(f"{name}_v"))

    def dense(at, v):
        m = np.zeros(block * block)
        m[at] = v
        return m.reshape(block, block)

    def multiply(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                z = dense(r.left_at, r.left_v) @ dense(r.right_at, r.right_v)
                i, j = np.nonzero(dense(r.left_at, 1.0) @ dense(r.right_at, 1.0))
                yield pd.DataFrame({"r": r.br * block + i, "c": r.bc * block + j, "v": z[i, j]})

    pairs = pack(a, "br", "bk", "left").join(pack(b, "bk", "bc", "right"), "bk").drop("bk")
    # a row has up to 24 bytes a place of a block; a batch is no more than a task's rows
    held = written(pairs)
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // BLOCKS_A_TASK))
    parts = held.repartition(tasks).mapInPandas(multiply, "r long, c long, v double")
    return parts.groupBy("r", "c").agg(F.sum("v").alias("v"))


def format_sizes(a: DataFrame, rows: int) -> DataFrame:
    """Bytes of the coordinate, row and padded forms with 4-byte numbers."""
    n = a.groupBy("r").count().agg(F.sum("count").alias("nnz"), F.max("count").alias("width"))
    return n.select(
        (F.col("nnz") * 12).alias("coo_bytes"), (F.col("nnz") * 8 + (rows + 1) * 4).alias("csr_bytes"), (F.col("width") * rows * 8 + rows * 4).alias("ell_bytes")
    )
