"""The pipeline on the smallest tables, stage by stage."""

import collections

import corpus_pipeline
from peakweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_language_stage_drops_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    strange = ["La volpe veloce salta sopra il cane pigro vicino al fiume oggi pomeriggio mentre piove", "Szybki brązowy lis przeskakuje nad leniwym psem obok rzeki", "Быстрая лиса прыгает через ленивую собаку", "#### 93 @@ x", "x 0100 ## 93 @@ 17", "qwxz kjhg zzxq vbnm wqqx"]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs.unionByName(more), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
