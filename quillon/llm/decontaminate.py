"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document that share a seed (``least`` consecutive words)
are tiled: the longest run of words which both have, and which no earlier tile
touches on either side, becomes a tile; again and again until no run of
``least`` words is left.  Runs are found by running Karp-Rabin hashes of
``least`` words that are extended along diagonals.  The share of the item's
words under tiles is its coverage; passages that were reordered, interrupted or
interleaved with other text are covered as well as verbatim ones.

Seeds are joined by Spark: a row for each seed of an item, and one for each seed of
a text that a filter of SEED_BITS bits, the same size for any benchmark, lets pass.
What an item's shared seeds can cover at most decides whether a text and an item
are a candidate; only candidates' texts move, each text once whatever copies it has,
and a task holds one text and one item at a time.  Other documents are never
shuffled.

Defined results: words are lower-cased (A-Z); null and empty texts match
nothing; an item of fewer than ``least`` words is its own seed; repeated items
or documents are judged each; an item without item_id is used, with item_id
null; in an empty benchmark nothing is found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Scratch, by_batch, documents, marked_rows, unused, wanted_rows

LEAST, COVERAGE = 5, 0.6
SEED_BITS = 1 << 25


class Seeds:
    """The runs of words by which items are found."""

    def __init__(self, items: list[np.ndarray], least: int):
        self.items, self.least = items, least
        short = {len(h) for h in items if 0 < len(h) < least}
        self.widths = sorted(short | {least})
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in self.widths:
            hashes, item, at = [], [], []
            for i, h in enumerate(items):
                if len(h) == w or w == least and len(h) > least:
                    c = wh.chain(h, w)
                    hashes.append(c)
                    item.append(np.full(len(c), i))
                    at.append(np.arange(len(c)))
            if hashes:
                hash_, item_, at_ = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
                order = np.argsort(hash_, kind="stable")
                self.of[w] = hash_[order], item_[order], at_[order]

    def hits(self, h: np.ndarray):
        """(item, width, positions in the item, positions in the document) of all shared runs."""
        for w, (hash_, item, at) in self.of.items():
            c = wh.chain(h, w)
            if not len(c):
                continue
            lo, hi = np.searchsorted(hash_, c, "left"), np.searchsorted(hash_, c, "right")
            n = hi - lo
            where = np.flatnonzero(n)
            if not len(where):
                continue
            doc = np.repeat(where, n[where])
            upto = np.cumsum(n[where]) - n[where]
            row = np.arange(len(doc)) - np.repeat(upto, n[where]) + np.repeat(lo[where], n[where])
            order = np.argsort(item[row], kind="stable")
            doc, row = doc[order], row[order]
            which, first = np.unique(item[row], return_index=True)
            for i, a, b in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
                yield i, w, at[row[a:b]], doc[a:b]


def tiles(i: np.ndarray, j: np.ndarray, width: int, n_item: int, n_doc: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of greedy tiles from shared runs of ``width`` words at (i, j)."""
    order = np.lexsort((i, j - i))
    i, d = i[order], (j - i)[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(i) - 1]])
    heap = [(-(int(i[b]) - int(i[a]) + width), int(i[a]), int(i[a] + d[a])) for a, b in zip(new, last)]
    heapq.heapify(heap)
    item, doc, out = np.zeros(n_item, bool), {}, []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = [not item[a + k] and b + k not in doc for k in range(size)]
        if all(free):
            out.append((a, b, size))
            item[a : a + size] = True
            doc.update((b + k, True) for k in range(size))
            continue
        k = 0
        while k < size:  # what is left of the run may still be a tile later
            if free[k]:
                e = k
                while e < size and free[e]:
                    e += 1
                if e - k >= width:
                    heapq.heappush(heap, (-(e - k), a + k, b + k))
                k = e
            else:
                k += 1
    return out


KIND = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles array<array<long>>"
#: Two hashes that stand for a text.
TEXT = ["t1", "t2"]


def _widths(sizes: list[int], least: int) -> list[int]:
    return sorted({n for n in sizes if 0 < n < least} | {least})


def _seeds(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words, unlike for unlike widths."""
    return wh.mix(wh.chain(h, width) + np.uint64(width)).view(np.int64)


def _item_seeds(least: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, _, h, first = wh.words(frame["text"].tolist(), True)
        rows = []
        for k, item in enumerate(frame["item"].tolist()):
            x = h[first[k] : first[k + 1]]
            width = min(least, len(x))
            s = _seeds(x, width) if width else np.zeros(0, np.int64)
            rows.append(pd.DataFrame({"seed": s, "item": np.full(len(s), item), "at": np.arange(len(s), dtype=np.int32), "width": width, "n": len(x)}))
        return pd.concat(rows)

    return run


def _text_seeds(bits, widths: list[int]):
    """The seeds of each text that the filter knows, each once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = np.frombuffer(bits.value, np.uint64)
        _, _, _, h, first = wh.words(frame["text"].tolist(), True)
        rows = []
        for k, (t1, t2) in enumerate(zip(frame["t1"].tolist(), frame["t2"].tolist())):
            for w in widths:
                s = _seeds(h[first[k] : first[k + 1]], w)
                at = s.view(np.uint64) % np.uint64(SEED_BITS)
                s = np.unique(s[(known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)])
                if len(s):
                    rows.append(pd.DataFrame({"t1": t1, "t2": t2, "seed": s}))
        return pd.concat(rows) if rows else pd.DataFrame({"t1": [], "t2": [], "seed": []}, dtype=np.int64)

    return run


def _tiled(least: int, coverage: float):
    """(t1, t2, item, covered, n, tiles) from rows sorted by text, its own row before those of its candidate items."""

    def run(frames):
        h = None
        for frame in frames:
            rows = []
            for t1, t2, item, text in zip(frame["t1"].tolist(), frame["t2"].tolist(), frame["item"].tolist(), frame["text"].tolist()):
                x = wh.words([text], True)[3]
                if pd.isna(item):
                    h = x
                    continue
                for _, w, i, j in Seeds([x], least).hits(h):
                    found = tiles(i, j, w, len(x), len(h))
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(x):
                        rows.append((t1, t2, int(item), covered, len(x), [list(map(int, t)) for t in sorted(found)]))
            if rows:
                yield pd.DataFrame(rows, columns=["t1", "t2", "item", "covered", "n", "tiles"])

    return run


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({names[0]: F.xxhash64(text), names[1]: F.xxhash64(F.lit(7), text)})


def matches(docs: DataFrame, benchmark: DataFrame, s: Scratch, least: int = LEAST, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(found, items): which texts (t1, t2) cover which items, and the items (item, item_id, copies)."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = rows.groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    items = s.save(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "copies", "text"), "items")
    seeds = s.save(items.select("item", "text").mapInPandas(by_batch(_item_seeds(least)), "seed long, item long, at int, width int, n long"), "seeds")
    widths = _widths([r.width for r in seeds.select("width").distinct().collect()], least)  # ``least`` of them at most
    bits = np.zeros(SEED_BITS // 64, np.uint64)
    place = F.expr(f"cast(pmod(cast(seed as decimal(20,0)) + case when seed < 0 then 18446744073709551616 else 0 end, {SEED_BITS}) as long)")  # unsigned
    held = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas()
    bits[held["w"].to_numpy(np.int64)] = held["b"].to_numpy(np.int64).view(np.uint64)
    bits = spark.sparkContext.broadcast(bits.tobytes())
    texts = _keyed(documents(docs).select("text").where("text is not null"), TEXT)
    shared = s.save(texts.mapInPandas(by_batch(_text_seeds(bits, widths)), "t1 long, t2 long, seed long").distinct(), "shared")
    # words that the shared seeds reach: an upper bound of what tiles cover
    pairs = shared.join(seeds, "seed").groupBy(*TEXT, "item", "width", "n").agg(F.array_sort(F.collect_set("at")).alias("places"))
    reach = F.aggregate(F.transform("places", lambda x, k: F.least(F.col("width"), F.coalesce(F.get("places", k + 1) - x, F.col("width")))), F.lit(0), lambda x, y: x + y)
    pairs = s.save(pairs.where(reach >= coverage * F.col("n")).select(*TEXT, "item"), "pairs")
    whole = wanted_rows(texts, "t1", pairs.select("t1")).join(pairs.select(*TEXT).distinct(), TEXT).groupBy(*TEXT).agg(F.first("text").alias("text"))
    both = whole.select(*TEXT, F.lit(None).cast("long").alias("item"), "text").unionByName(pairs.join(items.select("item", "text"), "item").select(*TEXT, "item", "text"))
    dealt = both.repartition(*TEXT).sortWithinPartitions(*TEXT, F.col("item").asc_nulls_first())
    found = dealt.mapInPandas(_tiled(least, coverage), "t1 long, t2 long, item long, covered long, n long, tiles array<array<long>>")
    return s.save(found, "found"), items.select("item", "item_id", "copies")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """A row for every document and item with coverage of at least ``coverage``; tiles: (item word, document word, length)."""
    s = Scratch(docs.sparkSession, "leaks")
    found, items = matches(docs, benchmark, s, least, coverage)
    rows = _keyed(documents(docs), TEXT).select("doc_id", *TEXT)
    met = wanted_rows(rows, "t1", found.select("t1")).join(found, TEXT).join(items, "item")
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return s.close(each.select("doc_id", "item_id", "covered", F.col("n").alias("item_words"), (F.col("covered") / F.col("n")).alias("coverage"), "tiles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns as they are, that cover no benchmark item."""
    s = Scratch(docs.sparkSession, "leaks")
    found, _ = matches(docs, benchmark, s, least, coverage)
    t1, t2, maybe = unused(docs.columns, *TEXT, "maybe")
    gone = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2)).distinct()
    # only texts that may go are dealt out to meet those that do
    rows = marked_rows(_keyed(docs, [t1, t2]), t1, gone.select(t1), maybe)
    left = rows.where(F.col(maybe)).join(gone, [t1, t2], "left_anti")
    return s.close(rows.where(~F.col(maybe)).unionByName(left).select(*docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "covered", "item_words", "coverage", F.size("tiles").alias("n_tiles"))
