"""Paragraph-wise translation with a cache, and the resumable state of batches.

The translator is a function of a pandas Series (a service, a model, a lookup);
it sees each distinct paragraph that is worth translating and not in the cache
once, in Arrow batches, with retries.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import paragraphs, strip_environment, worth_translating
from ..operators.relations import upsert
from ..operators.rounds import written
from ..sources.versions import Conflict, Store, read_version, write_version


def with_retries(fn: Callable[[pd.Series], pd.Series], tries: int = 5, pause: float = 1.0) -> Callable[[pd.Series], pd.Series]:
    """fn, tried again after growing pauses."""

    def run(x: pd.Series) -> pd.Series:
        for n in range(tries):
            try:
                return fn(x)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(pause * 2**n * (1 + random.random() / 10))
        raise AssertionError

    return run


def translate_documents(docs: DataFrame, cache: DataFrame, translate: Callable[[pd.Series], pd.Series], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents with translated text, the extended cache of (hash, value)).

    Paragraphs after the bibliography's begin, and those that aren't worth it,
    stay; environment tags around a paragraph stay as well.
    """
    parts = paragraphs(docs.select(key, "text"))
    began = F.max(F.when(F.contains("paragraph", F.lit("\\begin{thebibliography}")), 1).otherwise(0))
    w = Window.partitionBy(key).orderBy("paragraph_no").rowsBetween(Window.unboundedPreceding, 0)
    head, body, tail = strip_environment(F.col("paragraph"))
    parts = parts.withColumn("late", began.over(w) == 1).select("*", head.alias("head"), body.alias("body"), tail.alias("tail"))
    parts = parts.withColumn("go", worth_translating(F.col("paragraph")) & ~F.col("late")).withColumn("hash", F.md5("body"))
    known = cache.select("hash", F.col("value").alias("new"))
    tried = with_retries(translate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": frame["hash"], "value": tried(frame["body"])})

    misses = parts.where("go").select("hash", "body").dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")
    fresh = written(misses.mapInPandas(run, "hash string, value string"))  # answers cost, so a lost executor must not ask again
    whole = cache.select("hash", "value").unionByName(fresh)
    done = parts.join(whole, "hash", "left")
    text = F.when(F.col("go") & F.col("value").isNotNull(), F.concat("head", "value", "tail")).otherwise(F.col("paragraph"))
    rows = done.select(key, "paragraph_no", text.alias("p")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "p"))).alias("r"))
    return rows.select(key, F.array_join(F.transform("r", lambda x: x["p"]), "\n\n").alias("text")), whole


def pending(tasks: DataFrame, status: DataFrame, key: str = "name", batch: int | None = None, now=None, stale: str | None = None, tries: int | None = None) -> DataFrame:
    """Tasks to be done, in order; the first ``batch`` of them if asked.

    SUCCESS and SKIPPED are done.  FAILED ones come again, up to ``tries`` times (column
    tries) where that is given.  RUNNING ones belong to another worker unless they
    began (column at) more than ``stale`` (an interval) before ``now``; without
    ``now`` there is no other worker.
    """
    held = F.col("status").isin("SUCCESS", "SKIPPED")
    if now is not None:
        old = F.col("at") < F.lit(now) - F.expr(f"interval {stale}") if stale else F.lit(False)
        held |= (F.col("status") == "RUNNING") & ~old
    if tries is not None:
        held |= (F.col("status") == "FAILED") & (F.col("tries") >= tries)
    left = tasks.join(status.where(held).select(key), key, "left_anti").orderBy(key)
    return left if batch is None else left.limit(batch)


def record(status: DataFrame, results: DataFrame, key: str = "name", order: str = "at") -> DataFrame:
    """The status table with new states, the latest per task."""
    return upsert(status, results, key, order)


class Tasks:
    """A table of states (name, status, worker, at, tries) that several workers share.

    Every change is a version of the table.  A worker that loses the race for a
    version reads the winner's and tries again, so no task is claimed twice; a
    worker that dies leaves RUNNING rows, which others take over when they are stale.
    """

    SCHEMA = "name string, status string, worker string, at timestamp, tries int"

    def __init__(self, spark, base: str):
        self.spark, self.base = spark, base

    def state(self, number: int | None = None) -> DataFrame:
        found = read_version(self.spark, self.base, number)
        return self.spark.createDataFrame([], self.SCHEMA) if found is None else found

    def _change(self, make: Callable[[DataFrame], DataFrame]) -> None:
        while True:
            number, _ = Store(self.spark, self.base).read()
            old = self.state(number or None)
            try:
                write_version(record(old, make(old)), self.base, after=number)
                return
            except Conflict:
                continue

    def claim(self, tasks: DataFrame, worker: str, now, batch: int, stale: str = "1 hour", tries: int | None = None) -> DataFrame:
        """Up to ``batch`` tasks (column name), RUNNING for this worker from now on."""

        def take(old: DataFrame) -> DataFrame:
            free = pending(tasks.select("name"), old, "name", batch, now, stale, tries).join(old.select("name", F.col("tries").alias("before")), "name", "left")
            return free.select("name", F.lit("RUNNING").alias("status"), F.lit(worker).alias("worker"), F.lit(now).cast("timestamp").alias("at"), (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("tries"))

        self._change(take)
        return self.state().where((F.col("status") == "RUNNING") & (F.col("worker") == worker) & (F.col("at") == F.lit(now).cast("timestamp"))).select("name")

    def finish(self, results: DataFrame, worker: str, now) -> None:
        """Records (name, status); results of tasks that another worker has taken over are left out."""

        def end(old: DataFrame) -> DataFrame:
            mine = old.where((F.col("status") == "RUNNING") & (F.col("worker") == worker)).select("name", "worker", "tries")
            return mine.join(results.select("name", "status"), "name").select("name", "status", "worker", F.lit(now).cast("timestamp").alias("at"), "tries")

        self._change(end)
