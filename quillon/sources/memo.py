"""Results kept under what they were made of: the plan, and the files that it reads."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .versions import Store, read_version, write_version

#: Classes of a plan's nodes whose text does not tell them apart: rows of the driver, functions, time.
_OPAQUE = re.compile(r"LogicalRDD|LocalRelation|ExternalRDD|OneRowRelation|Python|Pandas|Arrow|ScalaUDF|\.Current\w+|\.Now\b")


def fingerprint(df: DataFrame, label: str = "") -> str | None:
    """A hash of the normalised plan, of name, size and time of every file that it reads, and of the label; None if the plan doesn't tell all."""
    spark, fields = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields)
    spark.conf.set(fields, str(1 << 30))  # no plan's text is cut
    try:
        plan = df._jdf.queryExecution().analyzed()
        text = plan.canonicalized().toString()
    finally:
        spark.conf.set(fields, before)
    classes = " ".join(re.findall(r'"class":"([^"]*)"', plan.toJSON()))
    if not label and (_OPAQUE.search(classes) or not plan.deterministic()):
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    files = []
    for name in sorted(df.inputFiles()):
        path = hadoop.Path(spark._jvm.java.net.URI(name))
        f = path.getFileSystem(conf).getFileStatus(path)
        files.append(f"{name} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\0".join([label, text, df.schema.simpleString(), *files]).encode()).hexdigest()


def remembered(df: DataFrame, base: str, label: str = "", keep: int | None = None) -> DataFrame:
    """df, from the table under base that holds its result; computed and written there if there is none.

    Inputs that have changed, or another plan, make another key.  Of more than
    ``keep`` results those that were used longest ago go.  A plan with functions
    or rows of the driver is remembered under a label only, which has to change
    with them.
    """
    key = fingerprint(df, label)
    if key is None:
        return df
    at = f"{base.rstrip('/')}/{key}"
    store = Store(df.sparkSession, at)
    found = read_version(df.sparkSession, at) if store.numbers() else write_version(df, at)
    store.fs.setTimes(store._path("_versions/000000000001"), store.spark._jvm.java.lang.System.currentTimeMillis(), -1)
    if keep is not None:
        evict(df, base, keep)
    return found


def evict(df: DataFrame, base: str, keep: int) -> None:
    """Drops all results but the ``keep`` used last."""
    top = Store(df.sparkSession, base)
    used = []
    for name in top._names(""):
        at = top._path(f"{name}/_versions/000000000001")
        used.append((top.fs.getFileStatus(at).getModificationTime() if top.fs.exists(at) else 0, name))
    for _, name in sorted(used)[: max(0, len(used) - keep)]:
        top.fs.delete(top._path(name), True)
