"""Connected components of a graph of links.

Defined results: repeated and reversed links count once; a link of a node with
itself counts for nothing; without links there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, marked_rows

#: A node of more links than HEAVY meets them in SALTS places.
HEAVY, SALTS = 64, 64


def _salted(rows: DataFrame, column: str, by: str, heavy: DataFrame) -> DataFrame:
    """rows with a salt from the column ``by``, 0 where the node in ``column`` isn't heavy."""
    salt = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    return marked_rows(rows, column, heavy, "is_heavy").withColumn("salt", salt).drop("is_heavy")


def _copied(rows: DataFrame, column: str, heavy: DataFrame) -> DataFrame:
    """rows with every salt where the node in ``column`` is heavy, else with 0."""
    salts = F.when(F.col("is_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked_rows(rows, column, heavy, "is_heavy").withColumn("salt", F.explode(salts)).drop("is_heavy")


def components(links: DataFrame, s: Scratch, name: str = "components") -> DataFrame:
    """(node, label) of all nodes of links (a, b); label: the smallest node of the component.

    A node takes the least label around it, then its label's label, until none
    changes; chains halve with every round.  Each round is written, so that a
    lost executor repeats one round at most.  A node of many links, and a label of
    many nodes, are dealt to several tasks: labels that won't change (they label
    themselves) are not looked up at all, so the label of a large component that
    is found already costs nothing.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = s.save(both, f"{name}-pairs")
    heavy = s.save(both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("node"), f"{name}-heavy")
    links = s.save(_salted(both, "b", "a", heavy), f"{name}-links")
    labels = s.save(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), f"{name}-0")
    s.drop(f"{name}-pairs")
    turn = 0
    while True:
        around = links.join(_copied(labels.withColumnRenamed("node", "b"), "b", heavy), ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        near = s.save(near, f"{name}-near{turn}")
        # labels that have another label themselves
        hops = near.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next")).join(near.select("label").distinct(), "label")
        hops = s.save(hops, f"{name}-hops")
        if hops.limit(1).count():
            often = near.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("label")
            asks = marked_rows(near, "label", hops.select("label"), "hops")
            moved = _salted(asks.where("hops"), "label", "node", often).join(_copied(hops, "label", often), ["label", "salt"], "left")
            moved = moved.select("node", "old", F.coalesce("next", "label").alias("label")).unionByName(asks.where("not hops").select("node", "old", "label"))
            moved = s.save(moved, f"{name}-{turn + 1}")
            s.drop(f"{name}-near{turn}")
        else:
            moved = near
        changed = moved.where("old <> label").limit(1).count()
        s.drop(f"{name}-{turn}", f"{name}-near{turn - 1}", f"{name}-hops")
        labels, turn = moved.select("node", "label"), turn + 1
        if not changed:
            s.drop(f"{name}-links", f"{name}-heavy")
            return labels
