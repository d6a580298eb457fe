"""Packing token pieces into windows of a fixed length.

Whole windows are cut off every document first.  What remains of each, its tail
(1 to window - 1 ids), is packed by length:

1. the histogram of tail lengths is counted (at most window - 1 numbers);
2. shallow combinations of two or three lengths that fill a window exactly are
   enumerated, and non-negative least squares finds how often to use each so
   that the lengths used match the histogram;
3. the repeat counts are rounded down, cut back where lengths run out, and each
   tail finds its combination, copy and place from its rank among the tails of
   its length;
4. tails left over are packed greedily, cut where a window is full, by the task
   that holds them; each task leaves one window unfilled at most.

Nothing but the histogram reaches the driver.  Ranks come from counts per
written partition, so no task sees all tails of a length.

Defined results: null text has the end id only; repeated rows are documents of
their own; an empty table gives no pieces.  Windows are padded to ``window``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as wh
from .common import Scratch, documents, trim
from .tokens import default_vocabulary, encode_frame

WINDOW = 2048
#: Ranks (lengths times partitions) that are broadcast at most; beyond, tails meet them by partition.
BROADCAST_RANKS = 4_000_000


def combinations(hist: np.ndarray, window: int, grid: int = 48) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to the window: all pairs, and triples with a frequent length."""
    have = np.flatnonzero(hist)
    if not len(have):
        return np.zeros((0, 3), np.int64)
    there = np.zeros(window + 1, bool)
    there[have] = True
    a = have[have * 2 <= window]
    a = a[there[window - a]]
    out = [np.stack([window - a, a, np.zeros_like(a)], 1)]
    # lengths that many tails have, and others evenly along the distribution
    common = have[np.argsort(-hist[have], kind="stable")[: grid // 2]]
    spread = have[np.searchsorted(np.cumsum(hist[have]), np.linspace(0, hist.sum(), grid // 2, endpoint=False), "right")]
    for b in np.unique(np.concatenate([common, spread])).tolist():
        x = have[have * 2 <= window - b]
        x = x[there[window - b - x]]
        out.append(np.stack([window - b - x, x, np.full_like(x, b)], 1))
    return np.unique(-np.sort(-np.concatenate(out), 1), axis=0)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the lengths used by x copies of each combination near the histogram (least squares).

    Accelerated projected gradient; the matrix is never formed.
    """
    window = len(hist)
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), window)
    back = lambda r: r[combos].sum(1)
    goal = hist.astype(float)
    goal[0] = 0

    def residual(x: np.ndarray) -> np.ndarray:
        r = used(x) - goal
        r[0] = 0  # an absent length costs nothing
        return r

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue sets the step
        u = used(v)
        u[0] = 0
        v = back(u)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(residual(y)) / norm)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, copies) such that no length is used more often than it occurs."""
    combos = combinations(hist, window)
    if not len(combos):
        return []
    x = nnls(combos, hist)
    left, out = hist.astype(np.int64).copy(), []

    def take(lengths: tuple[int, ...], most: int) -> None:
        need = np.bincount(lengths, minlength=len(left))
        n = min([most, *(int(left[i] // need[i]) for i in set(lengths))])
        if n > 0:
            for i in set(lengths):
                left[i] -= n * need[i]
            out.append((lengths, n))

    order = np.argsort(-x, kind="stable")
    rows = [tuple(int(i) for i in combos[j] if i) for j in order]
    for lengths, n in zip(rows, x[order].tolist()):
        take(lengths, int(n))
    for lengths in rows:  # what rounding left and still fits exactly
        take(lengths, int(left.sum()))
    return out


class Places:
    """For a tail's length and rank: sequence and offset, or none where the plan has no place for it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        total: dict[int, int] = {}
        self.sequences = 0
        for lengths, copies in patterns:
            offset = 0
            for n in lengths:
                by.setdefault(n, []).append((total.get(n, 0), self.sequences, offset))
                total[n] = total.get(n, 0) + copies
                offset += n
            self.sequences += copies
        self.total, self.by = total, {n: np.array(rows, np.int64) for n, rows in by.items()}

    def find(self, length: int, rank: int) -> tuple[int, int] | None:
        if rank >= self.total.get(length, 0):
            return None
        rows = self.by[length]
        first, base, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].tolist()
        return base + rank - first, offset


TAILS = "part int, row long, doc_id long, n long, full_before long, crcs array<long>, tail int, tail_rank long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tails(vocabulary: str, end_id: int, window: int, by_word: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row, full = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        for frame in frames:
            for lo, hi in wh.batches(frame["text"].tolist()):
                piece, rows = frame.iloc[lo:hi], []
                for doc, ids in zip(piece["doc_id"].tolist(), encode_frame(piece, vocabulary, end_id, by_word)):
                    raw, n = ids.astype("<u4"), len(ids)
                    whole, tail = divmod(n, window)
                    crcs = [zlib.crc32(raw[i * window : (i + 1) * window].tobytes()) for i in range(whole)]
                    kind = "<u2" if not n or raw.max() < 1 << 16 else "<u4"
                    rows.append((part, row, doc, n, full, crcs, tail, int(seen[tail]), raw[whole * window :].astype(kind).tobytes()))
                    row, full = row + 1, full + whole
                    seen[tail] += 1
                yield pd.DataFrame(rows, columns=["part", "row", "doc_id", "n", "full_before", "crcs", "tail", "tail_rank", "ids"]).astype({"doc_id": "Int64"})
                trim()

    return run


def _place(places: Places, window: int, base: int, total: int):
    """Pieces of the documents of a partition; sequences from base hold whole windows, from base + total what is left over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, filled = TaskContext.get().partitionId(), 0, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                for i, crc in enumerate(r.crcs):
                    out.append((r.doc_id, i * window, window, crc, r.n, base + r.full_start + i, 0))
                if not r.tail:
                    continue
                start = len(r.crcs) * window
                raw = np.frombuffer(r.ids, "<u2" if len(r.ids) == 2 * r.tail else "<u4").astype("<u4")
                if found := places.find(r.tail, r.rank):
                    out.append((r.doc_id, start, r.tail, zlib.crc32(raw.tobytes()), r.n, *found))
                    continue
                done = 0
                while done < r.tail:
                    n = min(r.tail - done, window - filled)
                    number = base + total + (made << 24 | task)  # tasks number their windows in turn
                    out.append((r.doc_id, start + done, n, zlib.crc32(raw[done : done + n].tobytes()), r.n, number, filled))
                    done, filled = done + n, filled + n
                    if filled == window:
                        made, filled = made + 1, 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, by_word: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    s = Scratch(docs.sparkSession, "pack")
    tails = s.save(documents(docs).mapInPandas(_tails(vocabulary, end_id, window, by_word), TAILS), "tails")
    counts = s.save(tails.groupBy("part", "tail").agg(F.count("*").alias("c")), "counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c")).collect():  # a row per length
        hist[r.tail] = r.c
    hist[0] = 0
    places = Places(plan(hist, window))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("c").over(before.partitionBy("tail").orderBy("part")), F.lit(0))
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("tail"))
    ranks = every.join(counts, ["part", "tail"], "left").select("part", "tail", earlier.alias("earlier"))
    # a row per partition: for each length, the tails of it in earlier partitions
    ranks = ranks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("tail", "earlier"))).alias("x"))
    ranks = s.save(ranks.select("part", F.col("x.earlier").alias("earlier")), "ranks")
    whole = tails.groupBy("part").agg(F.sum(F.size("crcs")).alias("w"))  # a row per partition
    whole = s.save(whole.select("part", F.coalesce(F.sum("w").over(before.orderBy("part")), F.lit(0)).alias("whole"), "w"), "whole")
    total = whole.agg(F.sum("w")).first()[0] or 0
    parts = whole.join(ranks, "part").select("part", "whole", "earlier")
    # eight bytes a length, so some tens of megabytes at most are broadcast
    rows = tails.join(F.broadcast(parts) if whole.count() * window <= BROADCAST_RANKS else parts.hint("merge"), "part")
    rank = F.col("tail_rank") + F.get("earlier", F.col("tail"))
    rows = rows.select("doc_id", "n", "crcs", "tail", "ids", rank.alias("rank"), (F.col("full_before") + F.col("whole")).alias("full_start"))
    return s.close(rows.mapInPandas(_place(places, window, places.sequences, total), PIECES))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), 1)
