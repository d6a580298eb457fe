"""Written results of rounds: a plan that doesn't grow with the rounds and survives lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where the session names none, as in tests, another."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and context.master.startswith("local"):
        base = _LOCAL["dir"] = _LOCAL.get("dir") or tempfile.mkdtemp(prefix="quillon-")
    return base or spark.conf.get("spark.sql.warehouse.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the process ends: what is built in it is a query's own."""
    path = f"{folder(spark).rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; its cluster cleans the folder
            pass

    atexit.register(delete)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read from the session's shared folder from now on."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


#: Numbers are kept as differences from their predecessors, so sorted ones take a byte or two.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


class Steps:
    """Tables of a job's steps, as packed files in the session's shared folder.

    Once a step is written, Spark may delete the shuffle files it was made with, and
    the job drops the tables that no later step reads.  So the disk holds one step at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_folder(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written under ``name`` and read again."""
        df.write.options(**PACKED).parquet(f"{self.root}/{name}")
        # shuffle files go once their plans are garbage; the listeners keep the last event, with its plan, until a job follows, as the look at the schema is
        out = self.spark.read.parquet(f"{self.root}/{name}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
