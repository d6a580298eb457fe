"""Filters, predicates and compaction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(values: DataFrame, keep: Column | None = None) -> DataFrame:
    """The rows that satisfy a predicate (by default: an even v), as a bag."""
    return values.where(F.col("v") % 2 == 0 if keep is None else keep)


def finite(column: str | Column) -> Column:
    """A number that is neither null, NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def close(a: Column, b: Column | float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def any_tag(tags: Column, wanted: Iterable[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def groups_by_predicate(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """A row for each named group that a row is in (a row may be in several), in one pass."""
    names = F.filter(F.array(*(F.when(p, F.lit(name)) for name, p in groups.items())), lambda x: x.isNotNull())
    return df.withColumn("group", F.explode(names))


def first_where(df: DataFrame, condition: Column, order: str, value: str) -> DataFrame:
    """value of the first row by ``order`` that satisfies the condition; null if none does."""
    return df.where(condition).agg(F.min_by(value, order).alias(value))


def below_percentile(df: DataFrame, column: str, share: float) -> DataFrame:
    """Rows under the exact percentile, which is one number joined to all rows."""
    edge = df.agg(F.percentile(column, share).alias("__edge"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(column) < F.col("__edge")).drop("__edge")
