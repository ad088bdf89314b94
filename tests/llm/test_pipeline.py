"""The five stages in a row."""

import corpus_pipeline
from sluice.llm import benchmark_decontamination, common, toxicity


def test_stages_take_effect_and_keep_the_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns, out = docs.count(), docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.checkpointed(stage(spark, out, sf))
        assert out.columns == columns
        counts.append(out.count())
    assert before > counts[0] >= counts[1] > counts[2] > counts[3] > before // 2
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert benchmark_decontamination.find_contamination(out, bench).filter("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    docs_of = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.collect()}
    assert docs_of(whole) == docs_of(packed) and {r[0] for r in key(whole)} == {r["doc_id"] for r in out.collect()}


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_toxic_documents_go(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - bad
