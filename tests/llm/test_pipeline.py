import os
from collections import defaultdict

import pytest

import corpus_pipeline
from terracell.llm import decontam, neardup, packing, pii, quality
from terracell.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert [k.split("_")[0] for k in QUERIES] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, DATA).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = kept
        if name != NAMES[-1]:
            assert kept.columns == docs.columns
    ids = {n: {r["doc_id"] for r in f.select("doc_id").collect()} for n, f in seen.items()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    predicted = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert ids["quality_classifier"] == predicted
    assert ids["simhash_near_dedup"] == {r["doc_id"] for r in neardup.keep_one(seen["quality_classifier"]).collect()}
    assert ids["simhash_near_dedup"] < ids["quality_classifier"]
    left = decontam.decontaminate(seen["benchmark_decontamination"], spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert left.where("contaminated").count() == 0 and ids["benchmark_decontamination"] < ids["simhash_near_dedup"]
    assert ids["pii"] == ids["benchmark_decontamination"] == ids["best_fit_packing"]
    again = pii.find(seen["pii"]).agg({"n_email": "sum", "n_card": "sum", "n_phone": "sum", "n_ip": "sum"}).first()
    assert all(not v for v in again)
    room = defaultdict(int)
    for r in seen["best_fit_packing"].collect():
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= packing.CAPACITY


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "some plain words of text", None, None, None)]
    spark.createDataFrame(rows, schema).selectExpr("*", "'x' as `_key`", "1 as node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 3}
