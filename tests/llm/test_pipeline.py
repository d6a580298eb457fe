from pyspark.sql import functions as F

import corpus_pipeline as C
from quillon.llm import toxicity

from . import brute
from .test_operators import check_pieces


def test_stages_equal_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in docs.collect() if toxicity.score_texts([r.text], model)[0][0] < 0.5]
    for name, stage in C.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check_pieces(docs.collect(), kept, 1)
            continue
        assert docs.columns == columns
        if name == "near_dedup":
            comp = brute.near(kept, 5, 80)
            kept = [(i, t) for i, t in kept if comp[i][1] == i]
        if name == "substring_dedup":
            cut = {i: (removed, sha) for i, _, removed, sha in brute.substring(kept, 50)}
            got = {r.doc_id: r for r in docs.withColumn("sha", F.sha2("text", 256)).collect()}
            assert all(got[i].text == t if not cut[i][0] else got[i].sha == cut[i][1] for i, t in kept)
            kept = [(i, got[i].text) for i, _ in kept]
        if name == "decontamination":
            bench = [set(zip(*(brute.words(brute.lower(r.text))[k:] for k in range(5)))) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            left = {r.doc_id for r in docs.collect()}
            for i, t in kept:  # a document that goes shares much with an item, one that stays has no item whole
                have = brute.shingles(t, 5)
                most = max(len(b & have) / len(b) for b in bench if b)
                assert most < 1 if i in left else most > 0.3
            kept = [(i, t) for i, t in kept if i in left]
        assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in kept), name


def test_stages_take_awkward_and_empty_tables(spark, data, tmp_path):
    rows, _ = brute.awkward(spark)
    rows.write.parquet(f"{tmp_path}/awkward")
    for df in (spark.read.parquet(f"{tmp_path}/awkward"), spark.read.parquet(f"{tmp_path}/awkward").limit(0)):
        for name, stage in C.STAGES:
            df = stage(spark, df, data)
            if name != "packing":
                assert df.columns == rows.columns
        df.count()


def test_run_applies_all_stages(spark, data):
    assert C.run(spark, data).count() > 0 and len(C.STAGES) == 5
