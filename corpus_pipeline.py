"""The corpus pipeline: toxic documents, near duplicates, repeated passages and benchmark leaks go; the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns
the columns of docs, but the last, which returns pieces of packed sequences.
run() writes what a stage returns and reads it again for the next.

Defined results follow from the operators': rows without doc_id pass all
filters but toxicity and contamination, which look at the text alone; empty
texts pass; columns beyond doc_id and text are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import OPEN, Scratch
from quillon.llm.decontaminate import decontaminate
from quillon.llm.near_dedup import without_near_duplicates
from quillon.llm.packing import pack
from quillon.llm.substring_dedup import without_repeats
from quillon.llm.tokens import default_vocabulary
from quillon.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones, doesn't call toxic."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near duplicates (five-word shingles, 0.8)."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that an earlier document has."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids, each document ended by id 1."""
    return pack(docs, default_vocabulary(), 1)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL can't express the trained filter nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    try:
        for name, stage in STAGES:
            opened = len(OPEN)
            docs = s.save(stage(spark, docs, sf_dir), name)
            # the stage's own tables, and what it read, are done with
            for tables in OPEN[opened:]:
                tables.end()
            if before:
                s.drop(before)
            before = name
    except BaseException:
        s.end()
        raise
    return docs
