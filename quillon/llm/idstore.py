"""Token-id files: ascending document order, raw fixed-width ids, and a minimal perfect hash per shard.

A store is a folder of two Parquet tables, ``shards`` and ``parts``.  A row of
``shards`` holds a run of consecutive documents, of SHARD_CHARS characters of text or
one longer document:

========== ==================================================================
part, seq  the writing partition and the shard's number in it; (part, seq)
           order is document order
rel_start  ids of the partition before this shard
first_key, last_key   the range of document keys
width      bytes of an id (2 where the vocabulary allows, else 4)
keys       the documents' keys in order (a null key is stored, not indexed)
levels     minimal perfect hash: one bit array per level
prints     for each slot, a 32-bit fingerprint of its key
entries    for each slot, (position of the key's first document, documents of that key)
bounds     offsets in ids of the documents, and the end
payload    the ids, little-endian, nothing in between
========== ==================================================================

A partition is a file.  Its values are neither compressed nor dictionary-coded, so
a payload's ids lie in the file as they are, and every value is a page of its own,
so the file's page index has each shard's place and its range of keys.

``parts``, a row per file, has the ids that lie before it (a global start is
rel_start plus that), its range of keys and its name.  Keyed access to few keys
opens the files whose range holds one, and of these the pages of the shards whose
range does: the store's size doesn't matter.  For many keys shards are found by
equality: the ranges are cut into cells about as wide as a shard's, and a shard
stands in the directory once for each cell that it touches (about twice as many
rows as shards).  What follows takes the same time whatever a shard's size: a
probe of the hash's packed bits, of which a count is stored every ``RANK_BITS``
bits, one fingerprint comparison and one slice; a key that isn't there is
refused by its fingerprint (or by the stored key).

Defined results: null text has the end id only; null keys come first and can be
read in sequence only; rows of the same key stay next to each other (ties by the
text's hash), and a keyed read gives them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as wh
from .common import Scratch, documents, trim, wanted_rows
from .tokens import default_vocabulary, encode_frame, encoder

MAX_LEVELS = 40
RANK_BITS = 512
#: Characters of a shard's texts, and of the texts that are encoded together.
SHARD_CHARS, ENCODED_CHARS = 1 << 20, 4 << 20
#: Keys that are looked up by the files' own indexes; more are joined with the directory.
SOUGHT = 200
#: One value a page, as it is: what a reader seeks is what it reads.
RAW = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1"}


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (wh.mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (wh.mix(keys.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1; other keys map anywhere or to -1.

    A level is a bit array; a key settles in the first level where no other key
    wants its bit.  A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[bytes]):
        """``levels``: of each, the number of bits, its bits that earlier levels and blocks have set, and the bits."""
        self.levels, self.parts = levels, []
        for raw in levels:
            size = int.from_bytes(raw[:8], "little")
            at = 8 + 8 * (size // RANK_BITS + 1)
            self.parts.append((size, np.frombuffer(raw, "<i8", size // RANK_BITS + 1, 8), np.frombuffer(raw, np.uint8, offset=at)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, before = [], np.asarray(keys, np.int64), 0
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = 2 * len(left)
            at = _place(left, len(levels), size)
            n = np.bincount(at, minlength=size)
            alone = n == 1
            ranks = before + np.concatenate([[0], np.cumsum(alone)])[: size + 1 : RANK_BITS]
            levels.append(size.to_bytes(8, "little") + ranks[: size // RANK_BITS + 1].astype("<i8").tobytes() + np.packbits(alone).tobytes())
            before += int(alone.sum())
            left = left[n[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, (size, ranks, bits) in enumerate(self.parts):
            if not len(open_):
                break
            at = _place(keys[open_], i, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            found = at[hit]
            # set bits of the block's bytes before, and of the own byte
            begin, whole = found // RANK_BITS * (RANK_BITS // 8), found >> 3
            span = np.arange(RANK_BITS // 8)
            before = np.minimum(begin[:, None] + span, len(bits) - 1)
            inside = np.where(begin[:, None] + span < whole[:, None], np.bitwise_count(bits[before]), 0).sum(1)
            own = np.bitwise_count(bits[whole] >> (8 - (found & 7)).astype(np.uint8) if len(whole) else bits[:0])
            out[open_[hit]] = ranks[found // RANK_BITS] + inside + np.where(found & 7, own, 0)
            open_ = open_[~hit]
        return out


SHARD = (
    "part int, seq int, rel_start long, first_key long, last_key long, width int, n_docs int, n_ids long, keys array<long>, "
    "levels array<binary>, prints binary, entries binary, bounds array<long>, payload binary"
)


def shard_row(keys: list[int | None], ids: list[np.ndarray], width: int) -> dict:
    sizes = [len(x) for x in ids]
    known = np.array([k for k in keys if k is not None], np.int64)
    offset = len(keys) - len(known)  # nulls come first
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    prints, entries = np.zeros(len(distinct), np.uint32), np.zeros((len(distinct), 2), np.uint32)
    prints[slot] = fingerprint(distinct)
    entries[slot] = np.stack([first + offset, count], 1) if len(distinct) else entries
    return {
        "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None, "width": width,
        "n_docs": len(keys), "n_ids": int(sum(sizes)), "keys": keys, "levels": index.levels, "prints": prints.tobytes(), "entries": entries.tobytes(),
        "bounds": np.cumsum([0, *sizes]).tolist(), "payload": np.concatenate(ids).astype(f"<u{width}").tobytes() if ids else b"",
    }


class Shard:
    """A row of ``shards``, opened."""

    def __init__(self, row):
        self.row, self.keys = row, row.keys
        self.index = PerfectHash(list(row.levels))
        self.prints = np.frombuffer(row.prints, np.uint32)
        self.entries = np.frombuffer(row.entries, np.uint32).reshape(-1, 2)
        self.bounds = np.asarray(row.bounds, np.int64)
        self.ids = np.frombuffer(row.payload, f"<u{row.width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents where the key isn't stored."""
        keys = np.asarray(keys, np.int64)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.index.slots(keys)
        there = (slot >= 0) & (self.prints[slot] == fingerprint(keys))
        first, count = self.entries[slot].astype(np.int64).T
        at = np.flatnonzero(there)  # the stored key itself tells a fingerprint that agrees by chance
        there[at] = [self.keys[i] == k for i, k in zip(first[at].tolist(), keys[at].tolist())]
        return first, np.where(there, count, 0)

    def read(self, document: int) -> np.ndarray:
        return self.ids[self.bounds[document] : self.bounds[document + 1]].astype(np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _write(vocabulary: str, end_id: int | None, by_word: bool, limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        width = 2 if encoder(vocabulary, by_word).tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        for frame in frames:
            for lo, hi in wh.batches(frame["text"].tolist(), max(limit, ENCODED_CHARS)):
                piece = frame.iloc[lo:hi]
                keys = [None if pd.isna(k) else int(k) for k in piece["doc_id"].tolist()]
                ids = encode_frame(piece, vocabulary, end_id, by_word)
                for a, b in wh.batches(piece["text"].tolist(), limit):
                    row = shard_row(keys[a:b], ids[a:b], width)
                    yield pd.DataFrame([{"part": part, "seq": seq, "rel_start": before, **row}])
                    seq, before = seq + 1, before + row["n_ids"]
                trim()

    return run


def write_store(docs: DataFrame, vocabulary: str, end_id: int | None, scratch: Scratch, by_word: bool = True, limit: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """Writes the ids of every text; returns (shards, parts).

    One shuffle, of the texts by ranges of doc_id; encoding and writing follow
    in the same stage.  A shard holds about ``limit`` characters of text or one
    longer document.
    """
    ordered = documents(docs).withColumn("tie", F.xxhash64("text"))
    # (doc_id, tie), so that rows of one doc_id, or of none, aren't bound to one task
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    shards = scratch.save(ordered.select("doc_id", "text").mapInPandas(_write(vocabulary, end_id, by_word, limit), SHARD), "shards", options=RAW)
    # a row per partition
    total = shards.groupBy("part", F.col("_metadata.file_path").alias("file")).agg(F.sum("n_ids").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return shards, scratch.save(total.select("part", F.coalesce(before, F.lit(0)).alias("before"), "first_key", "last_key", "file"), "parts")


def _each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            shard, out = Shard(row), []
            keys = [None if k is None or k != k else int(k) for k in row.keys]
            first, count = shard.find(np.array([0 if k is None else k for k in keys], np.int64))
            for i, k in enumerate(keys):
                if k is not None and not first[i] <= i < first[i] + count[i]:
                    raise ValueError(f"the index does not lead to document {k}")
                ids = shard.read(i)
                out.append((k, row.part, row.rel_start + int(shard.bounds[i]), len(ids), crc(ids), ids))
            yield pd.DataFrame(out, columns=["doc_id", "part", "rel", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})


def read_store(shards: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every stored document, each reached through its shard's index."""
    rows = shards.mapInPandas(_each, "doc_id long, part int, rel long, n_tokens long, ids_crc32 long, ids array<long>")
    return rows.join(parts.select("part", "before"), "part").select("doc_id", (F.col("rel") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _each(frames):
        yield frame.drop(columns="ids")


def _probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            shard, out = Shard(row), []
            wanted = np.asarray(row.wanted, np.int64)
            for k, first, count in zip(wanted.tolist(), *map(np.ndarray.tolist, shard.find(wanted))):
                out += [(k, row.part, row.rel_start + int(shard.bounds[i]), shard.read(i)) for i in range(first, first + count)]
            yield pd.DataFrame(out, columns=["doc_id", "part", "rel", "ids"])


def _any(tests: list):
    """The tests joined by or, as a shallow tree."""
    half = len(tests) // 2
    return tests[0] if len(tests) == 1 else _any(tests[:half]) | _any(tests[half:])


def seek(parts: DataFrame, keys: list[int]) -> DataFrame | None:
    """The shards whose range holds one of the keys, read by the indexes of the files that have such; None if no file has."""
    holds = _any([(F.col("first_key") <= k) & (F.col("last_key") >= k) for k in keys])
    files = [unquote(r.file) for r in parts.where(holds).select("file").distinct().collect()]  # a key lies in few files
    return parts.sparkSession.read.schema(SHARD).parquet(*files).where(holds) if files else None


def lookup(shards: DataFrame, parts: DataFrame, keys: DataFrame, sought: int = SOUGHT) -> DataFrame:
    """doc_id, start, ids of the asked keys (column doc_id) that are stored; absent keys give no row.

    Up to ``sought`` keys are read from their places in the files; for more, all
    shards are read once, and those whose range holds an asked key are opened.
    """
    kind = "doc_id long, part int, rel long, ids array<long>"
    asked = keys.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    few = sorted(r.key for r in asked.limit(sought + 1).collect())
    if len(few) <= sought:
        near = seek(parts, few) if few else None
        if near is None:
            return shards.sparkSession.createDataFrame([], "doc_id long, start long, ids array<long>")
        array = F.array(*map(F.lit, few)).cast("array<long>")
        rows = near.withColumn("wanted", F.filter(array, lambda k: k.between(F.col("first_key"), F.col("last_key")))).mapInPandas(_probe, kind)
    else:
        directory = shards.where("first_key is not null").select("part", "seq", "first_key", "last_key")
        r = directory.agg(F.min("first_key"), F.max("last_key"), F.count("*")).first()  # one row
        bits = min(63, int((r[1] - r[0]) // r[2]).bit_length()) if r[2] else 0
        cell = lambda c: F.shiftright(F.col(c), bits)
        directory = directory.select("part", "seq", "first_key", "last_key", F.explode(F.sequence(cell("first_key"), cell("last_key"))).alias("cell"))
        found = asked.withColumn("cell", cell("key")).join(directory, "cell").where("key between first_key and last_key")
        found = found.groupBy("part", "seq").agg(F.collect_set("key").alias("wanted"))
        # only the shards that are asked for are moved, but for a few
        near = wanted_rows(shards.withColumn("shard", F.xxhash64("part", "seq")), "shard", found.select(F.xxhash64("part", "seq").alias("shard"))).drop("shard")
        rows = near.join(found, ["part", "seq"]).mapInPandas(_probe, kind)
    return rows.join(parts.select("part", "before"), "part").select("doc_id", (F.col("rel") + F.col("before")).alias("start"), "ids")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "ids")
    shards, parts = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), 2, s)
    rows = shards.mapInPandas(_digest, "doc_id long, part int, rel long, n_tokens long, ids_crc32 long").join(parts.select("part", "before"), "part")
    return s.close(rows.select("doc_id", (F.col("rel") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
