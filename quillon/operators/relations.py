"""Lookups, merges, orderings and combinations of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounds_of_keys(rows: DataFrame, key: str, order: list[str], keys: int) -> DataFrame:
    """(key, first, last): positions of each key of 0..keys-1 in the rows sorted by key, as lower and upper bounds.

    Both follow from counts: the lower bound of a key is the number of smaller
    ones, so rows are never ordered.
    """
    n = rows.groupBy(F.col(key).cast("long").alias("key")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(keys).withColumnRenamed("id", "key")
    dense = every.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    from .scans import prefix_sum

    out = prefix_sum(dense, "key", "n", "first", exclusive=True)
    return out.select("key", "first", (F.col("first") + F.col("n")).alias("last"))


def lookup_last(left: DataFrame, right: DataFrame, key: str, value: str, order: str, default: str = "missing") -> DataFrame:
    """left with right's value by key (of duplicates the last in order), and a flag where there is none."""
    latest = right.groupBy(key).agg(F.max_by(value, order).alias(value), F.lit(True).alias("__has"))
    return left.join(latest, key, "left").withColumn(default, F.coalesce("__has", F.lit(False)) == F.lit(False)).drop("__has")


def cache_lookup(rows: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, distinct misses), by the text's md5."""
    keyed = rows.withColumn("hash", F.md5(F.col(text)))
    hits = keyed.join(cache.select("hash", "value"), "hash")
    misses = keyed.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    return hits, misses


def extend_cache(cache: DataFrame, computed: DataFrame) -> DataFrame:
    """The cache with new entries; those that were there stay."""
    new = computed.select("hash", "value").join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    return cache.select("hash", "value").unionByName(new)


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def update_by_key(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """old with the given columns replaced where new has a value for the key."""
    columns = list(columns)
    fresh = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = old.join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest by order."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(v, side, idx, pos) of two runs (idx, v) merged in order of v; of equal values a's come first, in their order."""
    return _ranked(a.select("v", F.lit(0).alias("side"), "idx").unionAll(b.select("v", F.lit(1).alias("side"), "idx")))


def _ranked(rows: DataFrame) -> DataFrame:
    """Positions by (v, side, idx), dealt to ordered buckets of all three, so that a common value lies in several."""
    from .scans import ranks

    return ranks(rows, [F.col("v"), F.col("side")], "idx", "pos").select("v", "side", "idx", "pos")


def co_rank(merged: DataFrame, k: int) -> DataFrame:
    """How many of the first k merged values are of the first run."""
    return merged.where(F.col("pos") < k).agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("long").alias("from_a"))


def sort_by_key(rows: DataFrame, key: str, *within: str) -> DataFrame:
    """Rows dealt by key and sorted within partitions, payload and all."""
    return rows.repartition(key).sortWithinPartitions(key, *within)


def arg_max(v: str | Column, at: str) -> Column:
    """Place of the largest value, the first of equals."""
    return F.max_by(at, F.struct(F.col(v) if isinstance(v, str) else v, -F.col(at)))


def arg_min(v: str | Column, at: str) -> Column:
    return F.min_by(at, F.struct(F.col(v) if isinstance(v, str) else v, F.col(at)))


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """All rows with their part's name; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to combine")
    return out
