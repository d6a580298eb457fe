"""What the operators share: table access, the shared scratch folder, batch helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, in Java's and Python's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, whatever other columns it has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the folder that driver and executors share, so that lost executors cost no recomputation.

    The folder is ``spark.checkpoint.dir``, or the checkpoint folder of the
    context; where neither is set, one in the warehouse, and in local mode, as in
    tests, a temporary one.  ``close(keep)`` deletes every table but ``keep``;
    what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not base and context.master.startswith("local"):
            base = _LOCAL["dir"] = _LOCAL.get("dir") or tempfile.mkdtemp(prefix="quillon-")
        base = base or spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root, self.names = spark, f"{base.rstrip('/')}/quillon-{tag}-{uuid.uuid4().hex}", set()
        OPEN.append(self)
        atexit.register(self.end)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """df, written under ``name`` and read again."""
        writer = df.write.mode("overwrite").options(**options or {})
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name)) if not partition_by else self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
            self.names.discard(name)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose result is written: it does so once their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self, keep: DataFrame | None = None, name: str = "result") -> DataFrame | None:
        """Write ``keep``, drop all else, and return ``keep`` as read again."""
        out = self.save(keep, name) if keep is not None else None
        self.drop(*(self.names - {name}))
        return out

    def end(self) -> None:
        """Delete all tables, the kept one too."""
        atexit.unregister(self.end)
        if self in OPEN:
            OPEN.remove(self)
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session has ended; its cluster cleans the folder
            pass


#: Folders in use, in the order they were opened.
OPEN: list[Scratch] = []


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all columns."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def trim() -> None:
    """Gives memory that a worker has freed back to the system; else pools of Arrow and the C library keep it for good."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bits of the filter that goes before the use of wide rows.
FILTER_BITS = 1 << 23


def marked_rows(rows: DataFrame, column: str, wanted: DataFrame, out: str, size: int = FILTER_BITS) -> DataFrame:
    """rows with a flag: true wherever the column is among the wanted ids (a single column), and on a few other rows.

    A bit for each wanted id's hash, ``size`` in all whatever their number,
    goes to all tasks (two megabytes at most, with FILTER_BITS); the rows are not shuffled.  With
    ever more wanted ids more other rows are flagged; exact joins follow
    wherever that matters.
    """

    def place(c: str):
        h = F.pmod(F.xxhash64(c), F.lit(size))
        return F.shiftright(h, 6), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({c}), {size}), 64) as int))")

    at, held = unused([*rows.columns, *wanted.columns, out], "word", "bits")
    (word, bit), (own_word, own_bit) = place(wanted.columns[0]), place(column)
    bits = wanted.groupBy(word.alias(at)).agg(F.bit_or(bit).alias(held))
    joined = rows.withColumn(at, own_word).join(F.broadcast(bits), at, "left")
    return joined.withColumn(out, F.coalesce(F.col(held).bitwiseAND(own_bit) != 0, F.lit(False))).drop(at, held)


def wanted_rows(rows: DataFrame, column: str, wanted: DataFrame, size: int = FILTER_BITS) -> DataFrame:
    """The rows whose column is among the wanted ids, and a few others (see marked_rows)."""
    (maybe,) = unused(rows.columns, "maybe")
    return marked_rows(rows, column, wanted, maybe, size).where(F.col(maybe)).drop(maybe)


#: Rows of an Arrow batch: with texts of some kilobytes, the default of 10,000 is a hundred megabytes in the JVM and as much in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has texts travel to Python workers in batches of BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def by_batch(fn: Callable[[pd.DataFrame], pd.DataFrame | None], limit: int = 4 << 20, column: str = "text") -> Callable:
    """For mapInPandas: fn over pieces of about ``limit`` characters of ``column``; a longer text is a piece of its own."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .wordhash import batches

        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            texts = frame[column].tolist()
            for lo, hi in batches(texts, limit):
                n = sum(len(t) for t in texts[lo:hi] if t)
                if held and size + n > limit:
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held, size = [], 0
                held.append(frame.iloc[lo:hi])
                size += n
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces(frames):
            out = fn(piece)
            if out is not None and len(out):
                yield out
            del out, piece
            trim()

    return run


def groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of one key at a time, from frames sorted by it; only one key is held beyond a frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(values)]
        for a, b in zip(bounds, bounds[1:]):
            piece = frame.iloc[a:b]
            if held and held[0][key].iloc[0] != piece[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
