"""Exact top-k inner products by a three-phase uniform threshold.

The components are dealt to ``lists`` vertical fragments; a partition of the
candidates holds one score list per fragment and query.

1. Each partition gathers, per query, the k best entries of every list and sums
   them up to full scores; it does so for its longest vectors, FIRST chunks of
   them.  The k-th best of all these is a safe cutoff: it belongs to a real
   candidate, so the true k-th score is no smaller.
2. The cutoff goes back to the partitions.  A list's entry is no more than the
   product of the fragments' lengths, so a chunk whose longest fragments can't
   reach a query's cutoff is passed over for that query, and one that can't reach
   any query's isn't multiplied at all (vectors come by falling length).  Of the
   others, a score of at least the cutoff needs some list entry of at least cutoff /
   lists, so only such entries are collected.
3. What is left of them is resolved to exact integer scores; each partition
   passes on its k best, and the last ranking is over those.

Queries are taken in blocks of ``block``, so what is broadcast (their vectors
and cutoffs) has a fixed size however many there are.

Defined results: a vector that is null, empty, or holds a null or non-finite
component takes no part, nor does a row without vec_id; vectors of unequal
length are compared as if filled up with zeros; rows that repeat a query's
vec_id are not its candidates, other repeated rows are candidates each; an equal
vec_id and vector asks once, unlike vectors of one vec_id ask each; scores that 64
bits can't hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Candidates scored at a time, and chunks of a partition that give the cutoff.
CHUNK, FIRST = 1024, 4


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * component) of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fit = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fit)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dims)] = v[:dims]
    return out


def _product(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where that is exact."""
    most = float(np.abs(c.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * c.shape[1] if c.size and q.size else 0.0
    if most < 2**52:
        return c.astype(np.float64) @ q.T.astype(np.float64)
    if most >= 2**62:
        exact = c.astype(object) @ q.T.astype(object)
        if max(map(abs, exact.ravel())) >= 2**63:
            raise OverflowError("a score needs more than 64 bits")
        return exact.astype(np.int64)
    return c @ q.T


def _lengths(x: np.ndarray, parts: list[slice]) -> np.ndarray:
    """The length of every row's fragments, rounded up."""
    return np.stack([np.sqrt((x[:, p].astype(np.float64) ** 2).sum(1)) for p in parts], 1) * (1 + 1e-9)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    start = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], score[keep]


def _pass(queries: np.ndarray, query_ids: np.ndarray, k: int, lists: int, cutoff: np.ndarray | None):
    """Phase 1 (without cutoff) or phases 2 and 3 over the candidates of a partition."""
    dims = queries.shape[1]
    parts = [slice(a[0], a[-1] + 1) for a in np.array_split(np.arange(dims), min(lists, dims))]

    asked = _lengths(queries, parts)

    def entries(ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        open_ = np.arange(len(queries))
        if cutoff is not None:
            open_ = np.flatnonzero(asked @ _lengths(c, parts).max(0) >= cutoff)
            if not len(open_):
                return None
        partial = [_product(c[:, p], queries[open_][:, p]) for p in parts]
        own = ids[:, None] == query_ids[None, open_]
        marked = np.zeros(own.shape, bool)
        for s in partial:
            if cutoff is None:
                s = np.where(own, -np.inf, s)
                np.put_along_axis(marked, np.argpartition(s, max(0, len(ids) - k), 0)[-k:], True, 0)
            else:
                # a score of at least the cutoff has a list entry of at least its share
                marked |= s >= np.floor(cutoff[open_] / len(parts))
        at, q = np.nonzero(marked & ~own)
        score = sum(s[at, q] for s in partial)
        if cutoff is not None:
            fit = score >= cutoff[open_][q]
            at, q, score = at[fit], q[fit], score[fit]
        return open_[q], ids[at], score.astype(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        for frame in frames:
            if cutoff is None and seen >= FIRST:
                continue
            ids, c = frame["vec_id"].to_numpy(np.int64), _matrix(frame["v"].tolist(), dims)
            for a in range(0, len(ids), CHUNK):
                new = entries(ids[a : a + CHUNK], c[a : a + CHUNK])
                seen += 1
                if new is not None:
                    held = _best(*(np.concatenate(x) for x in zip(held, new)), k)
        if len(held[0]):
            yield pd.DataFrame({"query_id": query_ids[held[0]], "vec_id": held[1], "score": held[2], "q": held[0]})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, lists: int = 2, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query with the rows of other ids.

    Both inputs hold vec_id and v (array of long).
    """
    spark = rows.sparkSession
    s = Scratch(spark, "topk")
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    rows, asked = s.save(rows.select("vec_id", "v").sortWithinPartitions(length.desc()), "rows"), s.save(queries.select("vec_id", "v").distinct(), "queries")
    blocks = -(-asked.count() // block) or 1
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).orderBy("vec_id", "v").toPandas()
        if not len(own):
            continue
        ids, q = own["vec_id"].to_numpy(np.int64), _matrix(own["v"].tolist(), dims)
        kind = "query_id long, vec_id long, score long, q int"
        first = rows.mapInPandas(_pass(q, ids, k, lists, None), kind)
        place = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        first = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        cut = np.full(len(ids), -np.inf)
        for r in first.where(F.col("rank") == k).select("q", "score").collect():  # a row per query of the block
            cut[r.q] = r.score
        best = rows.mapInPandas(_pass(q, ids, k, lists, cut), kind)
        best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        best = s.save(best.select("query_id", "rank", "vec_id", "score"), f"block{b}")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return s.close(found)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


SQL8 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
