import re

import corpus_pipeline as C
import odd
from pyspark.sql import functions as F
from riskframe.llm import decontaminate, quality, simhash


def test_stages_follow_one_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    steps = []
    for name, stage in C.STAGES:
        before, docs = docs, stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps.append((name, before, docs))
        if len(steps) < len(C.STAGES):
            assert docs.columns == before.columns
    ids = [[r.doc_id for r in after.select("doc_id").collect()] for _, _, after in steps]
    assert sorted(ids[4]) == sorted(ids[3]) == sorted(ids[2]) and set(ids[2]) <= set(ids[1]) <= set(ids[0])

    raw = {r.doc_id: r.text for r in steps[0][1].collect()}
    rules = quality.learn(steps[0][1], spark.read.parquet(f"{data}/labels.parquet"))
    assert sorted(ids[0]) == sorted(r.doc_id for r in quality.judge(steps[0][1], rules).where("kept").collect())
    alike = {}
    for r in simhash.near_duplicates(steps[1][1]).collect():
        alike.setdefault(r.component_id, set()).add(r.doc_id)
    assert all(len(set(ids[1]) & group) <= 1 for group in alike.values()) and len(ids[1]) <= len(alike)
    assert sorted(ids[2]) == sorted(r.doc_id for r in decontaminate.scan(steps[2][1], bench).where("not contaminated").collect())
    for r in steps[3][2].collect():
        assert not re.search(r"@mail\d", r.text) or r.text != raw[r.doc_id]
        assert r.n_chars == len(r.text)
    assert C.run(spark, data).count() == len(ids[4])


def test_odd_rows_pass_every_stage(spark, data):
    docs = odd.docs(spark).withColumn("n_chars", F.col("size").cast("long")).withColumn("lang", F.lit("en"))
    for rows in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            out = stage(spark, rows, data)
            assert out.count() <= rows.count()
